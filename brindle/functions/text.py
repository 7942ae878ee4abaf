"""Text expressions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import vocabulary as V

#: White space as Python's ``str`` methods and Unicode regular expressions see it.
SPACE = r"(?U)[\s\x1c-\x1f\x85]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+$", "")


def words(c: Column | str) -> Column:
    """The pieces between white space; an empty array for a blank text."""
    return F.filter(F.split(col(c), SPACE), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def clean(c: Column | str) -> Column:
    """Runs of white space become one space, then control characters go, then the ends are trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(col(c), SPACE, " "), r"[\x00-\x1f\x7f-\x9f]", ""))


def truncate(c: Column | str, max_length: int, suffix: str = "...") -> Column:
    c = col(c)
    return F.when(F.length(c) <= max_length, c).otherwise(F.concat(F.substring(c, 1, max_length - len(suffix)), F.lit(suffix)))


def keywords(c: Column | str, min_length: int = 3) -> Column:
    """Distinct lower-case words of ASCII letters that are no stop words, sorted."""
    found = F.regexp_extract_all(F.lower(col(c)), F.lit(rf"(?U)\b[a-zA-Z]{{{min_length},}}\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: ~w.isin(V.STOP_WORDS))))


def sha256(c: Column | str) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def sanitize_filename(c: Column | str) -> Column:
    """Path characters become underscores, control characters go, names over 255 characters keep their extension."""
    name = F.regexp_replace(F.regexp_replace(col(c), r'[<>:"/\\|?*]', "_"), r"[\x00-\x1f\x7f-\x9f]", "")
    ext = F.substring_index(name, ".", -1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext) - 1)
    short = F.when(F.contains(name, F.lit(".")) & (ext != ""), F.concat(F.substring(stem, F.lit(1), 254 - F.length(ext)), F.lit("."), ext))
    short = F.coalesce(short, F.when(F.contains(name, F.lit(".")), F.substring(stem, 1, 255)), F.substring(name, 1, 255))
    return F.when(F.length(name) > 255, short).otherwise(name)


def file_extension(c: Column | str) -> Column:
    c = col(c)
    return F.when(F.contains(c, F.lit(".")), F.lower(F.substring_index(c, ".", -1))).otherwise("")


def is_email(c: Column | str) -> Column:
    return F.rlike(col(c), F.lit(V.EMAIL_PATTERN))


def phi_matches(c: Column | str) -> Column:
    """array<struct<type, text, start, end>> of personal data, pattern after pattern, in text order.

    Positions come from the pieces between matches: a match starts where the last one ended, after the piece between.
    """
    c = col(c)
    kind = "array<struct<type:string,text:string,start:int,end:int>>"

    def of(name: str, pattern: str) -> Column:
        found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
        both = F.zip_with(F.split(c, pattern, -1), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
        both = F.filter(both, lambda x: x["m"].isNotNull())

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.length(x["m"])
            return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(F.lit(name).alias("type"), x["m"].alias("text"), start.alias("start"), end.alias("end"))).alias("out"))

        placed = F.aggregate(both, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])
        return F.when(F.rlike(c, F.lit(pattern)), placed).otherwise(F.array().cast(kind))  # most texts have matches of a few patterns

    return F.concat(*[of(k, p) for k, p in V.PHI_PATTERNS])


def redact_phi(c: Column | str, replacement: str = "[REDACTED]") -> Column:
    """All patterns replaced, one after the other; a replacement is never matched again by letters and digits in brackets."""
    c = col(c)
    for _, pattern in V.PHI_PATTERNS:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def context_window(c: Column | str, start: Column, end: Column, window: int) -> Column:
    """The text from ``window`` characters before ``start`` to as many after ``end`` (0-based, end exclusive)."""
    lo = F.greatest(start - window, F.lit(0))
    return F.substring(col(c), lo + 1, end + window - lo)


def code_blocks(c: Column | str) -> Column:
    """struct<code: array, explanation>: parts at odd places between triple backticks; first and last part explain."""
    parts = F.split(col(c), "```", -1)
    code = F.filter(parts, lambda _, i: i % 2 == 1)
    explanation = F.when(F.size(parts) > 1, strip(F.concat(F.element_at(parts, 1), F.element_at(parts, -1)))).otherwise(strip(F.element_at(parts, 1)))
    return F.struct(code.alias("code"), explanation.alias("explanation"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays of distinct values; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def head_words(c: Column | str, n_chars: int = 200) -> Column:
    return F.array_distinct(words(F.lower(F.substring(col(c), 1, n_chars))))


# --- documents ---------------------------------------------------------------------------------


def document_type(name: Column | str) -> Column:
    """By the file name, in this order; everything else is ``other``."""
    n, out = F.lower(col(name)), F.lit("other")
    for kind in ("protocol", "sap", "adam", "sdtm"):
        out = F.when(F.contains(n, F.lit(kind)), F.lit(kind)).otherwise(out)
    return out


def study_id(name: Column | str, content: Column | str) -> Column:
    """The first of four patterns that the name, or else the first 1000 characters of content, has; null if none."""
    tried = []
    for p in V.STUDY_ID_PATTERNS:
        tried += [F.nullif(F.regexp_extract(x, f"(?iU){p}", 1), F.lit("")) for x in (col(name), F.substring(col(content), 1, 1000))]
    return F.coalesce(*tried)


def study_id_strict(name: Column | str) -> Column:
    """The part of a file name before its first underscore, if it has one."""
    return F.when(F.contains(col(name), F.lit("_")), F.substring_index(col(name), "_", 1))


def domains(content: Column | str, word_boundary: bool = False) -> Column:
    """Sorted keys of a JSON object (or of the first object of an array); else the codes that occur in the text."""
    c = col(content)
    codes = V.SDTM_DOMAINS + V.ADAM_DATASETS
    hit = (lambda d: F.rlike(c, F.concat(F.lit(r"\b"), d, F.lit(r"\b")))) if word_boundary else (lambda d: F.contains(c, d))
    keys = F.coalesce(F.json_object_keys(c), F.json_object_keys(F.get_json_object(c, "$[0]")))
    is_json = F.rlike(c, F.lit(r"^\s*[\[{]")) & F.try_parse_json(c).isNotNull()
    return F.array_sort(F.when(is_json, F.coalesce(F.array_distinct(keys), F.array().cast("array<string>"))).otherwise(F.filter(F.array(*map(F.lit, codes)), hit)))


def document_id(path: Column | str, content: Column | str) -> Column:
    return F.concat(F.lit("doc_"), F.substring(sha256(path), 1, 16), F.lit("_"), F.substring(sha256(content), 1, 16))


def metadata(path: Column | str, content: Column | str) -> Column:
    name = F.substring_index(col(path), "/", -1)
    suffix = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    return F.struct(name.alias("file_name"), suffix.alias("file_extension"), F.octet_length(col(content)).cast("bigint").alias("file_size"), study_id(name, content).alias("study_id"))


# --- queries -----------------------------------------------------------------------------------


def any_contained(c: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(c, t))


def medical_terms(c: Column | str) -> Column:
    """How many medical terms occur in the text, as substrings of its lower case."""
    low = F.lower(col(c))
    return F.size(F.filter(F.array(*map(F.lit, V.MEDICAL_TERMS)), lambda t: F.contains(low, t)))


def analyze_query(c: Column | str) -> Column:
    """struct<strategy, is_question, medical_term_count, has_identifiers, is_complex, word_count>."""
    c = col(c)
    low = F.lower(c)
    question, medical, n = any_contained(low, V.QUESTION_WORDS), medical_terms(c), word_count(low)
    ids = F.rlike(c, F.lit(f"(?U){V.IDENTIFIER_PATTERN}")) | F.rlike(low, F.lit(f"(?U){V.DOMAIN_CODE_PATTERN}"))
    complex_ = (n > 10) | (medical > 2)
    strategy = F.when(ids, "keyword").when(complex_ & (medical > 1), "semantic").when(question, "hybrid").otherwise("adaptive")
    return F.struct(
        strategy.alias("strategy"), question.alias("is_question"), medical.alias("medical_term_count"),
        ids.alias("has_identifiers"), complex_.alias("is_complex"), n.alias("word_count"),
    )


def key_terms(c: Column | str) -> Column:
    """Words of over three letters that are no stop words, and medical terms, in order."""
    return F.filter(words(F.lower(col(c))), lambda w: ((F.length(w) > 3) & ~w.isin(V.KEY_TERM_STOP_WORDS)) | w.isin(V.MEDICAL_TERMS))


def boolean_query(terms: Column) -> Column:
    return F.array_join(terms, " | ")


def expansions(c: Column | str, per_term: int = 2) -> Column:
    """The lower-cased query with a known term replaced by each of its first synonyms."""
    low = F.lower(col(c))
    tried = [F.when(F.contains(low, F.lit(term)), F.replace(low, F.lit(term), F.lit(s))) for term, synonyms in V.SYNONYMS.items() for s in synonyms[:per_term]]
    return F.array_compact(F.array(*tried))


def adaptive_weight(c: Column | str, mode: Column | None = None, base: float = V.DENSE_WEIGHT) -> Column:
    """Weight of dense results: more for medical terms, long queries and the semantic mode; 1 at most."""
    w = F.lit(base) + F.when(medical_terms(c) > 0, 0.1).otherwise(0.0) + F.when(word_count(c) > 8, 0.1).otherwise(0.0)
    if mode is not None:
        w = w + F.when(mode == "semantic", 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(w, 6))


def identifier_boost(query: Column | str, content: Column | str, step: float = 0.2) -> Column:
    """``step`` for each identifier of the query that the content holds, in any case."""
    low = F.lower(col(content))
    ids = F.regexp_extract_all(col(query), F.lit(f"(?U){V.IDENTIFIER_PATTERN}"), F.lit(0))
    return F.aggregate(ids, F.lit(0.0), lambda a, i: a + F.when(F.contains(low, F.lower(i)), step).otherwise(0.0))


def term_frequency_relevance(query: Column | str, content: Column | str) -> Column:
    """Occurrences of the query's words in the content, over the content's words; 1 at most, 0 for a blank content."""
    low = F.lower(col(content))
    hits = F.aggregate(words(F.lower(col(query))), F.lit(0), lambda a, t: a + ((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)).cast("int"))
    n = word_count(content)
    return F.when(n > 0, F.least(F.lit(1.0), hits / n)).otherwise(0.0)
