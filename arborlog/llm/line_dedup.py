"""Boilerplate lines by their frequency within a site.

Lines are grouped by host; the pages of a host that hold a line, divided by the pages of the host, give its
ratio, and lines above the ratio go. Each page counts a line once, and only the digest of a line (128 bits)
travels, summed on the map side, so a hot host or line gathers nowhere. What is left is a list of boilerplate digests
for each host, at most 1 / ratio times the lines of an average page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

RATIO = 0.05
#: Pages with a line, at least, before it can be boilerplate: on a host of under 40 pages one or two would be above the ratio.
LEAST_PAGES = 3
#: Boilerplate digests (16 bytes each) that are broadcast at most; beyond, hosts are joined by salt.
BROADCAST_LINES = 500_000
SALTS = 32


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without port or user; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(docs: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, line, pages, total): digests of the lines that are on more than ``ratio`` of the pages of their host."""
    pages = docs.select(host.alias("host"), docs[text_col].alias("t")).where("host is not null")
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    lines = pages.where("t is not null").select("host", F.explode(F.array_distinct(F.filter(_lines(F.col("t")), lambda x: F.trim(x) != ""))).alias("line"))
    counts = lines.groupBy("host", _digest(F.col("line")).alias("line")).agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    return counts.join(totals, "host").where(F.col("pages") > F.col("total") * ratio)


def drop_boilerplate(docs: DataFrame, host: Column | None = None, text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(row, kept, lines, dropped): for each row of ``docs`` itself as a struct, its text without its boilerplate lines, and how many lines it had and lost.

    The row is a struct, so columns of ``docs`` may have any names. Every row stays, be its text empty afterwards. Blank lines
    are no boilerplate. A null text stays null, with no lines; a row without a host keeps its text; an empty text has one empty
    line; a text of any length is one row throughout. Repeated rows count as so many pages; lines that are as frequent as the ratio stay.
    """
    host = docs["source"] if host is None else host
    found = saved(boilerplate(docs, host, text_col, ratio, least_pages).select("host", "line"))
    n = found.count()
    lists = found.groupBy("host").agg(F.collect_list("line").alias("bad"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), host.alias("host"), docs[text_col].alias("t"))
    if n <= BROADCAST_LINES:
        rows = rows.join(F.broadcast(lists), "host", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int"))
        lists = lists.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        rows = rows.join(lists, ["host", "salt"], "left")
    every = _lines(F.col("t"))
    stay = F.when(F.col("bad").isNull(), every).otherwise(F.filter(every, lambda x: (F.trim(x) == "") | ~F.array_contains("bad", _digest(x))))
    rows = rows.select("row", "t", every.alias("every"), stay.alias("stay"))
    count = lambda c: F.when(F.col("t").isNull(), 0).otherwise(F.size(c)).cast("long")
    return rows.select("row", F.when(F.col("t").isNotNull(), F.array_join("stay", "\n")).alias("kept"), count("every").alias("lines"), (count("every") - count("stay")).alias("dropped"))


def clean(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents with the text that is left, and ``n_chars`` (if they have it) of that text."""
    rows = drop_boilerplate(docs, text_col=text_col, **how)
    out = {c: F.col("row").getField(c) for c in docs.columns}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("dropped") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    out[text_col] = F.col("kept")
    return rows.select(*[c.alias(name) for name, c in out.items()])


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("row.doc_id", "row.source", F.col("lines").alias("n_lines"), F.col("dropped").alias("n_dropped"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def oracle(ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> str:
    return f"""
WITH l AS (SELECT source, doc_id, list_distinct(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS ls FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
c AS (SELECT source, line, count(*) AS pages FROM (SELECT source, unnest(ls) AS line FROM l) GROUP BY ALL),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY 1),
b AS (SELECT source, list(line) AS bad FROM c JOIN t USING (source) WHERE pages >= {least_pages} AND pages > total * CAST({ratio} AS DOUBLE) GROUP BY 1),
k AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS w, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') = '' OR bad IS NULL OR NOT list_contains(bad, x)) AS kept FROM documents LEFT JOIN b USING (source))
SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(w) END::BIGINT AS n_lines,
  CASE WHEN text IS NULL THEN 0 ELSE len(w) - len(kept) END::BIGINT AS n_dropped,
  sha256(CASE WHEN text IS NULL OR len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END) AS kept_sha256
FROM k"""
