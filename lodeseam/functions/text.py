"""Tokens, query expansion and relevance scores as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, generic terms, question terms, word forms, related concepts.
STOP_WORDS = ("a", "an", "and", "are", "can", "do", "does", "for", "how", "in", "is", "it", "of", "the", "to", "what", "where", "which")
GENERIC_TERMS = ("code", "implemented", "implementation", "implement", "repository", "work", "works")
IMPLEMENTATION_TERMS = ("behavior", "flow", "implemented", "implementation", "process", "work", "works")
FILTER_TERMS = ("filter",)
SORT_TERMS = ("partition", "quicksort", "sort")
WORD_FORMS = {
    "categories": "category", "filtered": "filter", "filtering": "filter", "filters": "filter", "foods": "food", "items": "item",
    "paginated": "paginate", "paginating": "paginate", "pagination": "paginate", "priced": "price", "prices": "price",
    "pricing": "price", "sorted": "sort", "sorting": "sort", "sorts": "sort",
}
CONCEPTS = {
    "auth": ("authenticate", "authentication", "credential", "email", "identity", "login", "password", "session", "signin"),
    "login": ("authenticate", "authentication", "credential", "password", "session", "signin"),
    "permission": ("access", "authorization", "permission", "policy", "role"),
    "authorization": ("access", "permission", "policy", "role"),
    "filter": ("category", "form", "input", "maximum", "parameter", "price", "range", "request", "slider"),
}
STRUCTURAL_THRESHOLD = 0.45
QUERY_INSTRUCTION = "Retrieve relevant source code, configuration, and technical documentation from a software repository that can answer the given question."

Text = str | Column


def _col(value: Text) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def token_sequence(text: Text) -> Column:
    """Words of ASCII letters and digits, camel case apart, in lower case and normal form; null text gives none."""
    spaced = F.regexp_replace(F.coalesce(_col(text), F.lit("")), "(?<=[a-z0-9])(?=[A-Z])", " ")
    forms = F.create_map(*[F.lit(x) for pair in WORD_FORMS.items() for x in pair])
    return F.transform(F.regexp_extract_all(spaced, F.lit("[A-Za-z][A-Za-z0-9]*"), 0), lambda w: F.coalesce(F.element_at(forms, F.lower(w)), F.lower(w)))


def tokens(text: Text) -> Column:
    return F.array_distinct(token_sequence(text))


def identifier(text: Text) -> Column:
    return F.array_join(token_sequence(text), "")


def focused_terms(query: Text) -> Column:
    """Tokens of a question without stop words and generic terms."""
    return F.array_except(tokens(query), strings(STOP_WORDS + GENERIC_TERMS))


def _meets(word: Column):
    return lambda t: t.startswith(word) | F.startswith(word, t)


def expanded_terms(query: Text) -> Column:
    """Tokens without stop words, and the related terms of each concept that one is a beginning of, or begins with."""
    asked = F.array_except(tokens(query), strings(STOP_WORDS))
    out = asked
    for trigger, related in CONCEPTS.items():
        near = F.exists(asked, _meets(F.lit(trigger)))
        out = F.array_union(out, F.when(near, strings(related)).otherwise(strings(())))
    return out


def query_text(query: Text) -> Column:
    """The text of a question that is embedded."""
    added = F.sort_array(F.array_except(expanded_terms(query), tokens(query)))
    bare = F.regexp_replace(_col(query), "(?U)^\\s+|\\s+$", "")
    longer = F.concat(F.lit("Question: "), bare, F.lit("\nRelated software-repository concepts: "), F.array_join(added, ", "))
    return F.when(F.size(added) == 0, bare).otherwise(longer)


def instructed(query: Column, instruction: str = QUERY_INSTRUCTION) -> Column:
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), query)


def document_text(file_path: Text, language: Text, chunk_type: Text, symbol: Text, start: Text, end: Text, content: Text) -> Column:
    """The text of a chunk that is embedded; nulls are empty."""
    part = lambda label, c: F.concat(F.lit(label), F.coalesce(_col(c).cast("string"), F.lit("")))
    named = F.coalesce(F.nullif(_col(symbol), F.lit("")), F.lit("(file or structural context)"))
    lines = F.concat(part("Symbol lines: ", start), part("-", end))
    return F.concat_ws(
        "\n", F.lit("Software repository source chunk"), part("File: ", file_path), part("Language: ", language), part("Chunk type: ", chunk_type),
        F.concat(F.lit("Symbol: "), named), lines, F.lit("Source:"), part("", content),
    )


def lexical_score(query: Text, content: Text, symbol: Text, path: Text) -> Column:
    asked = F.array_except(expanded_terms(query), strings(GENERIC_TERMS))
    there = F.array_union(F.array_union(tokens(content), tokens(symbol)), tokens(path))
    n = F.size(asked)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(asked, there)) / F.least(F.lit(6), n)))


def file_stem(path: Text) -> Column:
    """A path's last part without its last suffix; a leading or a closing dot begins none."""
    parts = F.filter(F.split(F.coalesce(_col(path), F.lit("")), "/"), lambda x: (x != "") & (x != "."))
    name = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))
    return F.when(name.endswith("."), name).otherwise(F.regexp_replace(name, "(?<=.)\\.[^.]*$", ""))



def exact_score(query: Text, symbol: Text, path: Text) -> Column:
    asked, focused = F.array_except(expanded_terms(query), strings(GENERIC_TERMS)), focused_terms(query)
    of_symbol, of_path = tokens(symbol), tokens(path)
    named = lambda name: (name != "") & F.exists(asked, lambda t: identifier(t) == name)
    share = lambda there: F.size(F.array_intersect(focused, there)) / F.size(focused)
    return (
        F.when(F.size(asked) == 0, 0.0)
        .when(named(identifier(symbol)) | named(identifier(file_stem(path))), 1.0)
        .when(F.size(focused) == 0, 0.0)
        .when(F.size(F.array_except(focused, of_symbol)) == 0, 1.0)
        .when(F.size(F.array_except(focused, of_path)) == 0, 0.9)
        .otherwise(F.greatest(share(of_symbol), share(of_path) * 0.9))
    )


def trivial_accessor(symbol: Text, content: Text) -> Column:
    """A name like that of a getter, at most five lines with text, and no control flow."""
    name = F.lower(F.coalesce(_col(symbol), F.lit("")))
    lines = F.filter(F.split(F.coalesce(_col(content), F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.trim(x).rlike("(?U)\\S"))
    flow = F.coalesce(_col(content), F.lit("")).rlike("(?U)\\b(if|for|while|switch|try)\\b")
    return name.rlike("^(size$|get|has|is|set)") & (F.size(lines) <= 5) & ~flow


def filter_structural_score(chunk_type: Text, symbol: Text, content: Text) -> Column:
    kind, of_symbol = F.lower(F.coalesce(_col(chunk_type), F.lit(""))), tokens(symbol)
    there = F.array_union(of_symbol, tokens(content))
    ranged = F.array_contains(there, "price") & F.array_contains(there, "range") & F.arrays_overlap(there, strings(("form", "input", "parameter", "request")))
    return (
        F.when(F.arrays_overlap(of_symbol, strings(SORT_TERMS)), 0.1)
        .when(kind.isin("html_document", "html_element"), F.when(ranged, 1.0).otherwise(0.25))
        .when(F.array_contains(there, "filter") | ranged, 1.0)
        .when(kind.isin("function", "method"), 0.45)
        .when(kind.endswith("_context"), 0.35)
        .otherwise(0.25)
    )


def structural_score(query: Text, chunk_type: Text, symbol: Text, content: Text) -> Column:
    kind, asked = F.lower(F.coalesce(_col(chunk_type), F.lit(""))), tokens(query)
    none_asked = F.size(F.array_except(expanded_terms(query), strings(GENERIC_TERMS))) == 0
    return (
        F.when(none_asked | ~F.arrays_overlap(asked, strings(IMPLEMENTATION_TERMS)), 0.0)
        .when(F.arrays_overlap(asked, strings(FILTER_TERMS)), filter_structural_score(chunk_type, symbol, content))
        .when(kind.isin("function", "method"), F.when(trivial_accessor(symbol, content), 0.25).otherwise(1.0))
        .when(kind == "constructor", 0.75)
        .when(kind.endswith("_context") | kind.isin("class", "interface", "record", "struct", "trait"), 0.55)
        .when(kind.isin("markdown_section", "document"), 0.25)
        .otherwise(0.5)
    )


def structural_threshold(query: Text) -> Column:
    asked = tokens(query)
    return F.when(F.arrays_overlap(asked, strings(IMPLEMENTATION_TERMS)) & F.arrays_overlap(asked, strings(FILTER_TERMS)), F.lit(STRUCTURAL_THRESHOLD))


def word_set(text: Text) -> Column:
    """Distinct words between white space, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(_col(text), F.lit(""))), "(?U)\\s+"), lambda w: w != ""))


def jaccard(left: Column, right: Column) -> Column:
    """Share of common words of two word sets; two empty sets have none."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(left, right)) / F.greatest(union, F.lit(1)))


def one_space(text: Text) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), "(?U)\\s+", " "))


# The same for a question that is a literal, on the driver.
def literal_tokens(text: str) -> list[str]:
    words = re.findall("[A-Za-z][A-Za-z0-9]*", re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", text))
    return list(dict.fromkeys(WORD_FORMS.get(w.lower(), w.lower()) for w in words))
