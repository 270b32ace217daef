"""Quality by distribution divergence, in DataFrame functions alone.

Every text's histograms of character classes and of common words are compared with references of the languages by
Jensen-Shannon distance (base 2, so between 0 and 1). A reference is the sum of the histograms of all documents that
name a language; every language of ``REFERENCE_WORDS`` words or more has one (their number is that of the languages). A
text is held against its nearest reference, as its own label may be wrong; a text of a language without a reference
passes, whatever else the input holds. Texts of fewer than ``LEAST_CHARS`` characters or
``LEAST_WORDS`` words are too short for the respective histogram and pass it.

Base rules: at least 20 words, and at most 30 % of the words in 8-word windows that the text holds twice or more. A
window is compared by a 64-bit hash, within one text only. Nulls: a null text has no words and fails the base rule; a
null language joins no reference. Repeated rows count as they come. Empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.common import settle

# Common words of four languages.
COMMON = {
    "en": "the of and to in a is that it for on was as with be by",
    "de": "der die und das den von zu mit ist im nicht ein eine auf für dem",
    "fr": "de la le et les des en un une du que pour dans qui est pas",
    "es": "de la que el en y los se del las un por con no una su",
}
WORDS = sorted({w for line in COMMON.values() for w in line.split()})
#: As they are written: small, with a capital, in capitals.
WRITTEN = sorted({x for w in WORDS for x in (w, w.capitalize(), w.upper())})
SPACE = " \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_WORDS = 200, 100
REFERENCE_WORDS = 1000
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.30, 0.31
WINDOW = 8


def removed(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def repeat_words(words: Column, n: Column) -> Column:
    """Words in windows that occur twice or more; ``words`` are hashes."""
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))


def covered(windows: Column) -> Column:
    """Words under the windows whose hash occurs twice: equal hashes meet by sorting, then places are put in order."""
    let = lambda value, use: F.transform(F.array(value), use)[0]
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = lambda s: F.sort_array(
        F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda x: x.isNotNull())
    )
    steps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
    return F.aggregate(let(let(pairs, again), steps), F.lit(0).cast("long"), lambda a, x: a + x)


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, common)``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bare = F.btrim("text", F.lit(SPACE))
    split = texts.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    counted = split.select(
        "doc_id",
        "lang",
        F.size("words").alias("n"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.transform(F.filter("words", lambda w: w.isin(WRITTEN)), lambda w: F.lower(w)).alias("known"),
        F.length("text").alias("length"),
        removed(F.col("text"), "[\\x20\\x09-\\x0D]+").alias("word_chars"),
        removed(F.col("text"), "[#*$%&|<>]+").alias("less_symbols"),
        removed(F.col("text"), "[^A-Z]+").alias("upper"),
        removed(F.col("text"), "[^0-9]+").alias("digits"),
        removed(F.col("text"), "[^.,;:!?'\"()-]+").alias("marks"),
        removed(F.col("text"), "[\\x00-\\x7F]+").alias("accented"),
        lines.alias("lines"),
    )
    windowed = counted.withColumns(
        {
            "windows": repeat_words(F.col("hashes"), F.col("n")),
            "n_symbols": F.col("length") - F.col("less_symbols"),
            "spaces": F.col("length") - F.col("word_chars"),
            "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        }
    )
    rest = F.col("length") - sum((F.col(c) for c in ("upper", "digits", "marks", "accented", "n_symbols", "spaces")), F.lit(0))
    chars = F.array(*[F.col(c).cast("double") for c in ("upper", "digits", "marks", "accented", "n_symbols", "spaces")], rest.cast("double"))
    bins = [(F.size("known") - F.size(F.array_remove("known", w))).cast("double") for w in WORDS]
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    return windowed.select(
        "doc_id",
        "lang",
        F.col("n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.when(again, covered(F.col("windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        chars.alias("chars"),
        F.array(*bins, (F.col("n") - F.size("known")).cast("double")).alias("common"),
    )


def references(rows: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Shares of character classes and of common words of each language with REFERENCE_WORDS words."""
    sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, k in (("chars", 7), ("common", len(WORDS) + 1)) for i in range(k)]
    by_lang = rows.where("lang is not null").groupBy("lang").agg(F.sum("n_words").alias("whole"), *sums).where(F.col("whole") >= REFERENCE_WORDS)
    out = {}
    for r in by_lang.orderBy("lang").collect():
        pair = []
        for c, k in (("chars", 7), ("common", len(WORDS) + 1)):
            counts = [r[f"{c}{i}"] for i in range(k)]
            whole = sum(counts)
            pair.append([x / whole if whole else 0.0 for x in counts])
        out[r["lang"]] = (pair[0], pair[1])
    return out


def distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of two lists of shares."""
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    part = lambda p, q: (term(p, (p + q) / 2) + term(q, (p + q) / 2)) / 2
    parts = F.zip_with(shares, F.array(*map(F.lit, reference)), part)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def nearest(shares: Column, references: list[list[float]]) -> Column:
    found = [distance(shares, q) for q in references]
    return F.least(*found) if len(found) > 1 else found[0] if found else F.lit(0.0)


def judge(docs: DataFrame, most_char: float = MOST_CHAR_DISTANCE, most_word: float = MOST_WORD_DISTANCE) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance,
    word_distance)``, a row for each row of ``docs``."""
    rows = settle(measured(docs))
    refs = references(rows)
    summed = rows.withColumns({"length": F.col("word_chars") + F.col("chars")[5], "whole": F.greatest("n_words", F.lit(1))})
    shared = summed.withColumns({"char_share": F.transform("chars", lambda x: x / F.greatest(F.col("length"), F.lit(1))), "word_share": F.transform("common", lambda x: x / F.col("whole"))})
    scored = shared.withColumns({"char_distance": nearest(F.col("char_share"), [c for c, _ in refs.values()]), "word_distance": nearest(F.col("word_share"), [w for _, w in refs.values()])})
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    length = F.col("length")
    unknown = F.col("lang").isNotNull() & ~F.coalesce(F.col("lang").isin(list(refs)), F.lit(False))
    fits = unknown | ((length < LEAST_CHARS) | (F.col("char_distance") <= most_char)) & ((F.col("n_words") < LEAST_WORDS) | (F.col("word_distance") <= most_word))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & fits).alias("kept"), "char_distance", "word_distance")


def _sql() -> str:
    """The same rows in DuckDB's SQL."""
    space = "[\\x20\\x09-\\x0D]+"
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    less = lambda pattern: f"length(regexp_replace(text, '{pattern}', '', 'g'))"
    return f"""
with d as (select row_number() over () as row, doc_id, lang, coalesce(text, '') as text from documents),
w as (select row, unnest(words) as word, unnest(range(len(words))) as i
  from (select row, list_filter(string_split_regex(text, '{space}'), lambda x: x <> '') as words from d)),
win as (select row, i, list(word) over (partition by row order by i rows between current row and {WINDOW - 1} following) as words from w),
twice as (select row, i from (select row, i, count(*) over (partition by row, words) as n from win where len(words) = {WINDOW}) where n > 1),
hit as (select row, count(distinct k) as n_repeat_words from (select row, unnest(range(i, i + {WINDOW})) as k from twice) group by row),
line as (select row, count(*) - count(distinct l) as n_dup_lines from (select row, unnest(string_split(text, chr(10))) as l from d)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by row),
n as (select row, count(*) as n_words from w group by row),
c as (select row, doc_id, lang, length(text) as chars, {less(space)} as word_chars, length(text) - {less("[#*$%&|<>]+")} as n_symbols,
  {less("[^A-Z]+")} as upper_, {less("[^0-9]+")} as digits, {less("[^.,;:!?''\"()-]+")} as marks, {less("[\x00-\x7F]+")} as accented from d),
m as (select c.row, doc_id, lang, coalesce(n_words, 0) as n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, chars,
  [upper_, digits, marks, accented, n_symbols, chars - word_chars, word_chars - upper_ - digits - marks - accented - n_symbols] as classes
  from c left join n using (row) left join line using (row) left join hit using (row)),
char_bin as (select row, lang, unnest(range(7)) as bin, unnest(classes)::double as k, greatest(chars, 1) as whole from m),
known as (select row, lower(word) as word, count(*) as k from w where word in ({quoted(WRITTEN)}) group by all),
other as (select m.row, n_words - coalesce(sum(k), 0) as k from m left join known using (row) group by m.row, n_words),
word_bin as (select m.row, lang, bin, coalesce(case when bin = '' then other.k else known.k end, 0)::double as k, greatest(n_words, 1) as whole
  from m cross join (select unnest([{quoted(["", *WORDS])}]) as bin) join other using (row) left join known on known.row = m.row and known.word = bin),
langs as (select lang from m where lang is not null group by lang having sum(n_words) >= {REFERENCE_WORDS}),
char_ref as (select lang as ref, bin, sum(k) / nullif(sum(sum(k)) over (partition by lang), 0) as q from char_bin semi join langs using (lang) group by lang, bin),
word_ref as (select lang as ref, bin, sum(k) / nullif(sum(sum(k)) over (partition by lang), 0) as q from word_bin semi join langs using (lang) group by lang, bin),
char_part as (select row, ref, k / whole as p, coalesce(q, 0) as q from char_bin join char_ref using (bin)),
word_part as (select row, ref, k / whole as p, coalesce(q, 0) as q from word_bin join word_ref using (bin)),
char_far as (select row, min(far) as far from (select row, ref, sqrt(greatest(0, sum((case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end
  + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2))) as far from char_part group by row, ref) group by row),
word_far as (select row, min(far) as far from (select row, ref, sqrt(greatest(0, sum((case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end
  + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2))) as far from word_part group by row, ref) group by row)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or n_repeat_words * 100 > n_words * 30 as base_failed,
  not (n_words < 20 or n_repeat_words * 100 > n_words * 30) and ((lang is not null and lang not in (select lang from langs))
    or ((chars < {LEAST_CHARS} or coalesce(char_far.far, 0) <= {MOST_CHAR_DISTANCE})
    and (n_words < {LEAST_WORDS} or coalesce(word_far.far, 0) <= {MOST_WORD_DISTANCE}))) as kept
from m left join char_far using (row) left join word_far using (row)
"""


SQL = _sql()
