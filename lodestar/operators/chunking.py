"""Splitting documents: fixed token windows, header-bound segments, and tables whose rows run on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import stripped, window_starts

# The headers at which a policy form is cut, and the patterns that name a segment.
HEADERS = r"SECTION\s+[IVXLCDM\d]+|CLAUSE\s+[A-Z]{2,4}-\d+|EXCLUSION\s+TABLE|E-\d{1,3}\s*[|—]|HOMEOWNERS\s+ENDORSEMENT|Form\s+Number:|END\s+OF\s+ENDORSEMENT"
TABLE_HEADER = r"(?i)EXCLUSION TABLE\s*[—-]\s*[A-Z0-9-]+\s+ed\.\s+[0-9]{2}-[0-9]{2}"
TABLE_ROW = r"(?m)^\|\s*E-\d{1,3}\s*\|"
CODE = r"E-\d{1,3}"
CLAUSE = r"CLAUSE\s+([A-Z]{2,4}-\d+)"
SECTION = r"SECTION\s+([IVXLCDM\d]+)"
SIGN = "\u0001"


def header_fields(text: Column, lines: int = 10) -> Column:
    """The ``key: value`` pairs of the first lines, split at the first colon, as a map; the last of a key counts."""
    rows = F.filter(F.slice(F.split(text, "\n"), 1, lines), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(rows, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))


def missing_fields(fields: Column, required: Sequence[str]) -> Column:
    return F.array_except(F.array(*map(F.lit, required)), F.map_keys(fields))


def token_windows(docs: DataFrame, keys: Sequence[str], size: int = 400, overlap: int = 50) -> DataFrame:
    """``keys, chunk_index, chunk_id, n_tokens, text`` of windows over white-space tokens of ``docs.text``."""
    toks = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != "")
    cut = docs.select(*keys, toks.alias("_t")).select(*keys, "_t", F.posexplode(window_starts(F.size("_t"), size, overlap)).alias("chunk_index", "_from"))
    part = F.slice("_t", F.col("_from") + 1, F.lit(size))
    return cut.select(*keys, "chunk_index", F.format_string("%s_naive_chunk_%03d", F.col(keys[0]).cast("string"), "chunk_index").alias("chunk_id"), F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("text"))


def segments(text: Column, headers: str = HEADERS, line_start: bool = True) -> Column:
    """The text cut before each header (at a line's start), trimmed, without empty parts."""
    lead = r"(?:^|\n)" if line_start else ""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), f"{lead}({headers})", f"{SIGN}$1")
    return F.filter(F.transform(F.split(marked, SIGN), stripped), lambda x: x != "")


def glue(parts: DataFrame, key: str, position: str, text: str, is_bare: Column) -> DataFrame:
    """Bare segments joined by a line feed to the one before: gaps and islands over the order of ``position``."""
    order = Window.partitionBy(key).orderBy(position)
    marked = parts.withColumn("_head", F.sum(F.when(is_bare & (F.row_number().over(order) > 1), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = marked.groupBy(key, "_head").agg(F.array_sort(F.collect_list(F.struct(position, text))).alias("_parts"))
    return joined.select(key, (F.col("_head") - 1).cast("int").alias("segment"), F.array_join(F.transform("_parts", lambda p: p[text]), "\n").alias(text))


def is_bare_row(text: Column) -> Column:
    return text.rlike(TABLE_ROW) & ~text.rlike(TABLE_HEADER)


def clause_id(text: Column) -> Column:
    """Table header, then coded table rows, then clause, then section; else ``PREAMBLE``."""
    codes = F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(CODE), F.lit(0))), "-")
    return (
        F.when(text.rlike(TABLE_HEADER), "EXCLUSION-TABLE")
        .when(text.rlike(TABLE_ROW), F.concat(F.lit("EXCLUSION-TABLE-"), codes))
        .when(text.rlike(CLAUSE), F.concat(F.lit("CLAUSE-"), F.regexp_extract(text, CLAUSE, 1)))
        .when(text.rlike(SECTION), F.concat(F.lit("SECTION-"), F.regexp_extract(text, SECTION, 1)))
        .otherwise("PREAMBLE")
    )


def structure_chunks(forms: DataFrame, size: int = 400, overlap: int = 50) -> DataFrame:
    """``forms(form_number, edition_date, text)`` → chunks with clause ids, long ones cut into windows.

    Order by ``(i, j)``: ``chunk_index`` (``i``, or ``i * 100 + j`` of a part) can meet a later whole segment's.
    """
    cut = forms.select("form_number", "edition_date", F.posexplode(segments(F.col("text"))).alias("_pos", "text"))
    glued = glue(cut.select("form_number", "_pos", "text"), "form_number", "_pos", "text", is_bare_row(F.col("text")))
    glued = glued.join(forms.select("form_number", "edition_date"), "form_number").withColumn("clause_id", clause_id(F.col("text")))
    body = F.concat(F.lit("["), "form_number", F.lit(" ed. "), "edition_date", F.lit("] "), "clause_id", F.lit("\n"), "text")
    toks = F.filter(F.split(body, r"\s+"), lambda t: t != "")
    parts = F.when(F.size(toks) > size, F.transform(window_starts(F.size(toks), size, overlap), lambda a: F.array_join(F.slice(toks, a + 1, F.lit(size)), " "))).otherwise(F.array(body))
    out = glued.withColumn("_parts", parts).select("form_number", "edition_date", "clause_id", F.col("segment").alias("i"), F.size("_parts").alias("_n"), F.posexplode("_parts").alias("j", "text"))
    whole = F.col("_n") == 1
    return out.select(
        "form_number", "edition_date", "clause_id", "i", "j",
        F.when(whole, F.format_string("%s_sa_chunk_%03d", "form_number", "i")).otherwise(F.format_string("%s_sa_chunk_%03d_%02d", "form_number", "i", "j")).alias("chunk_id"),
        F.when(whole, F.col("i")).otherwise(F.col("i") * 100 + F.col("j")).alias("chunk_index"), "text",
    )


def fold_rows(lines: DataFrame, key: str, position: str, code: Column, text: Column, separator: str = " ") -> DataFrame:
    """Lines without a code are added to the last coded line before; lines before any code are left out.

    → ``(key, entry, code, text, n_lines)``.
    """
    order = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select(key, position, code.alias("_code"), text.alias("_text")).withColumn("entry", F.sum(F.when(F.col("_code").isNotNull(), 1).otherwise(0)).over(order)).where("entry > 0")
    joined = marked.groupBy(key, "entry").agg(F.max("_code").alias("code"), F.array_sort(F.collect_list(F.struct(position, "_text"))).alias("_rows"), F.count("*").alias("n_lines"))
    return joined.select(key, F.col("entry").cast("long").alias("entry"), "code", F.array_join(F.transform("_rows", lambda r: r["_text"]), separator).alias("text"), "n_lines")


def exclusion_schedule(forms: DataFrame) -> DataFrame:
    """Every exclusion of ``forms(form_number, text)``: table rows, with continuation rows folded into the coded one."""
    row = r"^\|\s*(E-\d+)?\s*\|\s*(.*?)\s*\|\s*(.*?)\s*\|\s*$"
    lines = forms.select("form_number", F.posexplode(F.split("text", "\n")).alias("_pos", "_line")).withColumn("_line", stripped(F.col("_line"))).where(F.col("_line").rlike(row))
    part = lambda i: F.regexp_extract("_line", row, i)
    lines = lines.where((part(1) != "") | ((part(3) != "") & ~part(3).rlike(r"^-+$")))
    folded = fold_rows(lines, "form_number", "_pos", F.nullif(part(1), F.lit("")), F.concat_ws("\u0000", part(2), part(3)), "\u0001")
    column = lambda i: F.array_join(F.filter(F.transform(F.split("text", "\u0001"), lambda r: F.split(r, "\u0000")[i]), lambda x: x != ""), " ")
    return folded.select("form_number", "entry", "code", column(0).alias("peril"), column(1).alias("scope"))
