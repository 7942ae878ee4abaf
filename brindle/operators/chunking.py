"""Chunkers: DataFrame of documents in, one row a chunk out.

Input columns: ``document_id``, ``content`` and, where a chunker routes by it, ``document_type``.
Output: ``document_id``, ``chunk_index``, ``id``, ``content``, ``start_char``, ``end_char``, ``token_count``
and chunker-specific columns. Tokens are words between white space unless a token array is
given. Everything stays within a document's row, so chunking never shuffles, except where vectors
of sentences are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions import text as T


def check_overlap(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError(f"0 <= overlap < size is needed, not {overlap} and {size}")


def window_starts(n: Column, size: int, overlap: int, to_end: bool) -> Column:
    """0-based starts of windows over ``n`` tokens, ``size - overlap`` apart.

    With ``to_end`` the last window is the first that reaches the end; else every start below ``n``
    counts, so the last window may lie inside the one before.
    """
    check_overlap(size, overlap)
    stride = size - overlap
    last = F.greatest(F.ceil((n - size) / F.lit(stride)), F.lit(0)) * stride if to_end else n - 1
    return F.when(n > 0, F.sequence(F.lit(0), last.cast("int"), F.lit(stride))).otherwise(F.array().cast("array<int>"))


def token_windows(docs: DataFrame, size: int = 512, overlap: int = 50, to_end: bool = True, tag: str = "chunk") -> DataFrame:
    """Fixed windows of words, joined by single spaces."""
    tokens = docs.withColumn("_tokens", T.words("content"))
    rows = tokens.select("document_id", "_tokens", F.posexplode(window_starts(F.size("_tokens"), size, overlap, to_end)).alias("chunk_index", "start_token"))
    piece = F.slice("_tokens", F.col("start_token") + 1, size)
    return rows.select(
        "document_id", "chunk_index", F.concat_ws(f"_{tag}_", "document_id", F.col("chunk_index").cast("string")).alias("id"),
        F.array_join(piece, " ").alias("content"), "start_token", F.size(piece).alias("token_count"),
    )


def sentences(c: Column | str) -> Column:
    """Pieces of a text, by the first of three rules that finds more than one: an end mark before a
    capital, an end mark, line breaks. Trimmed, without empty ones."""
    c = T.strip(c)
    tries = [F.split(c, p) for p in (r"(?U)(?<=[.!?])\s+(?=[A-Z])", r"(?U)(?<=[.!?])\s+", r"\n+")]
    chosen = F.when(F.size(tries[0]) > 1, tries[0]).when(F.size(tries[1]) > 1, tries[1]).otherwise(tries[2])
    return F.filter(F.transform(chosen, T.strip), lambda s: s != "")


def sentence_rows(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", F.posexplode(sentences("content")).alias("pos", "sentence"))


def semantic_groups(rows: DataFrame, quantile: float = 0.25) -> DataFrame:
    """Rows (document_id, pos, sentence, embedding) with ``grp``: a new group starts after each
    sentence whose similarity to the next (to 9 decimals) lies below the document's quantile."""
    from brindle.operators.vectors import cosine

    order = W.partitionBy("document_id").orderBy("pos")
    near = rows.withColumn("similarity", F.round(cosine(F.col("embedding"), F.lead("embedding").over(order)), 9))
    cut = F.percentile("similarity", F.lit(quantile)).over(W.partitionBy("document_id"))
    breaks = near.withColumn("_break", F.coalesce((F.col("similarity") < cut - 1e-9).cast("int"), F.lit(0)))
    return breaks.withColumn("grp", F.coalesce(F.sum("_break").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_break")


def semantic_chunks(rows: DataFrame, max_tokens: int = 512, overlap: int = 0) -> DataFrame:
    """Groups of sentences joined by spaces; those over ``max_tokens`` words are cut into windows.

    ``boundary`` is the similarity to the next chunk's first sentence, 1.0 for the last chunk.
    """
    joined = semantic_groups(rows).groupBy("document_id", "grp").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda s: s["sentence"]), " ").alias("content"),
        F.coalesce(F.max_by("similarity", "pos"), F.lit(1.0)).alias("boundary"), F.count("*").alias("n_sentences"),
    )
    words = joined.withColumn("_w", T.words("content"))
    parts = F.transform(window_starts(F.size("_w"), max_tokens, overlap, True), lambda i: F.array_join(F.slice(F.col("_w"), i + 1, max_tokens), " "))
    whole = F.size("_w") <= max_tokens
    out = words.select("document_id", "grp", "boundary", "n_sentences", whole.alias("_whole"), F.posexplode(F.when(whole, F.array("content")).otherwise(parts)).alias("split", "content"))
    tag = F.when(F.col("_whole"), F.concat(F.lit("_semantic_"), F.col("grp").cast("string"))).otherwise(F.concat_ws("_", F.lit("_semantic_split"), F.col("grp").cast("string"), F.col("split").cast("string")))
    return out.select("document_id", F.concat("document_id", tag).alias("id"), "grp", "split", "content", "boundary", "n_sentences", T.word_count("content").alias("token_count"))


def hierarchical_chunks(docs: DataFrame, rows: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Semantic chunks for documents that give 2 to 20 of them, fixed windows for the others."""
    found = semantic_chunks(rows, size)
    good = found.groupBy("document_id").count().where("count between 2 and 20").select("document_id")
    kept = found.join(good, "document_id", "left_semi").select("document_id", "id", "content", "token_count", F.lit("semantic").alias("method"))
    rest = token_windows(docs.join(good, "document_id", "left_anti"), size, overlap, to_end=False, tag="fixed")
    return kept.unionByName(rest.select("document_id", "id", "content", "token_count", F.lit("fixed").alias("method")))


def adaptive_chunks(docs: DataFrame, rows: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Clinical trials and adverse event reports by meaning, all other types hierarchically."""
    by_meaning = F.col("document_type").isin("clinical_trial", "ae_report")
    ids = docs.where(by_meaning).select("document_id")
    first = semantic_chunks(rows.join(ids, "document_id", "left_semi"), size).select("document_id", "id", "content", "token_count", F.lit("semantic").alias("method"))
    others = docs.where(~F.coalesce(by_meaning, F.lit(False)))
    return first.unionByName(hierarchical_chunks(others, rows.join(ids, "document_id", "left_anti"), size, overlap))


def pack(pieces: Column, size: int, joint: str = "\n\n") -> Column:
    """Pieces put together in order as long as they have ``size`` words together; a larger one stands alone."""
    kind = "array<struct<content:string,n:int>>"

    def step(acc: Column, piece: Column) -> Column:
        n, last = T.word_count(piece), F.try_element_at(acc, F.lit(-1))
        alone = F.array_append(acc, F.struct(piece.alias("content"), n.alias("n")))
        together = F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.struct(F.concat_ws(joint, last["content"], piece).alias("content"), (last["n"] + n).alias("n")))
        return F.when((F.size(acc) > 0) & (last["n"] + n <= size), together).otherwise(alone)

    return F.aggregate(pieces, F.array().cast(kind), step)


def paragraph_chunks(docs: DataFrame, size: int = 512, pattern: str = r"\n\s*\n") -> DataFrame:
    """Paragraphs between blank lines, packed; one over ``size`` words is cut into windows."""
    paragraphs = F.filter(F.transform(F.split("content", pattern), T.strip), lambda p: p != "")
    cut = F.flatten(F.transform(paragraphs, lambda p: F.when(T.word_count(p) <= size, F.array(p)).otherwise(
        F.transform(F.sequence(F.lit(1), T.word_count(p), F.lit(size)), lambda i: F.array_join(F.slice(T.words(p), i, size), " ")))))
    rows = docs.select("document_id", F.posexplode(pack(cut, size)).alias("chunk_index", "c"))
    return rows.select("document_id", "chunk_index", F.concat_ws("_chunk_", "document_id", F.col("chunk_index").cast("string")).alias("id"), "c.content", F.col("c.n").alias("token_count"))


def markdown_chunks(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Sections by headers of levels 1 to 6, each with its title, cut into windows.

    Text before the first header is a section without a title if there is only one header or none,
    and is dropped otherwise.
    """
    header = r"(?m)^#{1,6}[ \t]+[^\n]*$"
    titles = F.transform(F.regexp_extract_all("content", F.lit(r"(?m)^#{1,6}[ \t]+([^\n]*)$"), F.lit(1)), T.strip)
    bodies = F.split("content", header, -1)
    sections = F.zip_with(F.slice(bodies, 2, F.size(bodies)), titles, lambda b, t: F.struct(t.alias("title"), b.alias("body")))
    lead = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.element_at(bodies, 1).alias("body")))
    rows = docs.withColumn("_t", titles).select("document_id", F.posexplode(F.when(F.size("_t") > 1, sections).otherwise(F.concat(lead, sections))).alias("section", "s"))
    rows = rows.select("document_id", "section", F.col("s.title").alias("section_title"), T.words("s.body").alias("_w"))
    parts = rows.select("document_id", "section", "section_title", "_w", F.explode(window_starts(F.size("_w"), size, overlap, True)).alias("start_token"))
    piece = F.slice("_w", F.col("start_token") + 1, size)
    return parts.select("document_id", "section", "section_title", "start_token", F.array_join(piece, " ").alias("content"), F.size(piece).alias("token_count"))


def json_chunks(docs: DataFrame, depth: int | None = None) -> DataFrame:
    """An array gives a chunk an item, an object a chunk a (dotted) key, anything else one chunk.

    What is no JSON falls back to one chunk ``text`` with ``parsed`` false, for the fixed windows. Without ``depth``
    objects are taken apart however deep they are nested, which is found by a pass over them.
    """
    from brindle.functions.scalars import deepest, flatten_json, is_json

    depth = deepest(docs, "content") if depth is None else depth

    c = F.col("content")
    struct = lambda k, v: F.struct(k.cast("string").alias("path"), v.cast("string").alias("content"))
    items = F.transform(F.from_json(c, "array<variant>"), lambda v, i: struct(i, F.to_json(v)))
    keys = F.transform(F.map_entries(flatten_json(c, depth)), lambda e: struct(e["key"], e["value"]))
    ok = is_json("content")
    parts = F.when(ok & F.startswith(F.ltrim(c), F.lit("[")), items).when(ok & F.startswith(F.ltrim(c), F.lit("{")), keys).otherwise(F.array(struct(F.lit("text"), c)))
    return docs.select("document_id", ok.alias("parsed"), F.posexplode(parts).alias("chunk_index", "p")).select("document_id", "chunk_index", "p.path", "p.content", "parsed")


def lenient_json(c: Column | str) -> Column:
    """Without the commas before closing brackets that strict JSON forbids."""
    return F.regexp_replace(T.col(c), r",(\s*[}\]])", "$1")


def row_chunks(rows: DataFrame, document: str, order: list[str], chunk_size: int = 512) -> DataFrame:
    """``max(1, chunk_size // 100)`` rows a chunk, in order within a document, as lines of JSON."""
    n = max(1, chunk_size // 100)
    numbered = rows.withColumn("_rn", F.row_number().over(W.partitionBy(document).orderBy(*order)) - 1)
    body = F.to_json(F.struct(*[c for c in rows.columns if c != document]))
    grouped = numbered.groupBy(document, F.floor(F.col("_rn") / n).alias("chunk_index")).agg(F.array_sort(F.collect_list(F.struct("_rn", body.alias("j")))).alias("r"))
    return grouped.select(F.col(document).alias("document_id"), "chunk_index", F.array_join(F.transform("r", lambda x: x["j"]), "\n").alias("content"), F.col("r")[0]["_rn"].alias("first_row"), F.element_at("r", -1)["_rn"].alias("last_row"))


def locate_chunk(content: Column, chunk: Column, after: Column | None = None) -> Column:
    """0-based offset of a chunk in its document from ``after`` on; -1 if it isn't there."""
    return F.position(chunk, content, F.lit(1) if after is None else after + 1) - 1


ROUTES = {"markdown": markdown_chunks, "json": json_chunks, "text": paragraph_chunks, "fixed": token_windows, "adaptive": adaptive_chunks}


def chunker(kind: str = "adaptive"):
    """A chunker by name; unknown names give the adaptive one."""
    return ROUTES.get(kind, adaptive_chunks)
