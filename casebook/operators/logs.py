"""Log-folder analysis.

Input is a file listing ``(rel, content)`` where ``rel`` is
``<incident>/<date folder>/<analyzer folder>/<path inside>``, as produced by
``sources.readers.log_tree``.  The newest date folder (name starting with
``dd-dd``) and, inside it, the newest folder whose lower-cased name contains
``output`` are chosen per incident with grouped maxima joined back (partial
aggregation, no per-incident sort).  Findings, sizes and flags read whole
files; ``*.log`` files in sub-folders are keyed by bare file name (the last
path wins).  Only the prompt text cuts what it shows: the first characters of
a key file, and of the last 5,000 characters of a nested log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T


def parse_paths(files: DataFrame, rel: str = "rel") -> DataFrame:
    parts = F.split(F.col(rel), "/")
    return files.select(
        "*",
        parts[0].alias("incident_id"),
        F.when(F.size(parts) >= 3, parts[1]).alias("date_folder"),
        F.when(F.size(parts) >= 4, parts[2]).alias("analyzer_folder"),
        F.element_at(parts, -1).alias("file_name"),
        (F.size(parts) - 3).alias("depth"),
    )


def select_newest(files: DataFrame) -> DataFrame:
    """Files of the newest date folder / newest output folder per incident."""
    p = parse_paths(files)
    dated = p.filter(F.col("date_folder").rlike(r"^\d{2}-\d{2}"))
    latest_date = dated.groupBy("incident_id").agg(F.max("date_folder").alias("date_folder"))
    in_date = dated.join(latest_date, ["incident_id", "date_folder"])
    out = in_date.filter(F.lower(F.col("analyzer_folder")).contains("output"))
    latest_an = out.groupBy("incident_id", "date_folder").agg(F.max("analyzer_folder").alias("analyzer_folder"))
    return out.join(latest_an, ["incident_id", "date_folder", "analyzer_folder"])


def wanted_files(listing: DataFrame, requested: DataFrame | None = None, names=None) -> DataFrame:
    """S10 + J14: of a listing (no contents) the files that an analysis reads:
    the key files and nested logs of the newest folders of the requested
    incidents."""
    if requested is not None:
        listing = parse_paths(listing).join(requested.select("incident_id").distinct(), "incident_id", "left_semi") \
            .select(*listing.columns)
    names = K.KEY_LOG_FILES if names is None else names
    chosen = select_newest(listing)
    return chosen.filter(((F.col("depth") == 1) & F.col("file_name").isin(*names))
                         | ((F.col("depth") > 1) & F.col("file_name").endswith(".log")))


def key_files(selected: DataFrame, names=None, head_cap: int | None = None) -> DataFrame:
    """Key files directly inside the chosen folder; whole, or with
    ``head_cap`` their first characters only."""
    names = K.KEY_LOG_FILES if names is None else names
    k = selected.filter((F.col("depth") == 1) & F.col("file_name").isin(*names))
    content = F.col("content") if head_cap is None else T.head(F.col("content"), head_cap, K.FILE_HEAD_SUFFIX)
    return k.select("incident_id", "date_folder", "analyzer_folder", "file_name",
                    content.alias("content"), F.lit("key").alias("kind"))


def nested_logs(selected: DataFrame, tail_cap: int | None = None) -> DataFrame:
    """``*.log`` files below the chosen folder, one per bare name; whole, or
    with ``tail_cap`` their last characters only."""
    n = selected.filter((F.col("depth") > 1) & F.col("file_name").endswith(".log"))
    content = F.col("content") if tail_cap is None else T.tail(F.col("content"), tail_cap)
    pick = F.max(F.struct(F.col("rel"), content.alias("c")))
    return (n.groupBy("incident_id", "date_folder", "analyzer_folder", "file_name").agg(pick["c"].alias("content"))
            .withColumn("kind", F.lit("nested")))


def log_insights(keys: DataFrame) -> DataFrame:
    """Error / policy / device findings per key file."""
    low = F.lower(F.col("content"))
    msgs = F.filter(F.array(
        F.when(low.contains("error") | low.contains("fail"),
               F.concat(F.col("file_name"), F.lit(": Contains error indicators"))),
        F.when(low.contains("policy"), F.concat(F.col("file_name"), F.lit(": Contains policy-related information"))),
        F.when(low.contains("device"), F.concat(F.col("file_name"), F.lit(": Contains device-related information"))),
    ), lambda x: x.isNotNull())
    return keys.select("incident_id", "file_name", F.posexplode(msgs).alias("n", "insight"))


def file_stats(keys: DataFrame, nested: DataFrame) -> DataFrame:
    """Characters per file; key files also get error / warning flags
    (``flags_checked`` tells which rows carry flags -- nested logs only report
    their size)."""
    low = F.lower(F.col("content"))
    k = keys.select("incident_id", "file_name", "kind", F.length("content").alias("chars"),
                    (low.contains("error") | low.contains("fail")).alias("has_error"),
                    low.contains("warn").alias("has_warning"), F.lit(True).alias("flags_checked"))
    n = nested.select("incident_id", "file_name", "kind", F.length("content").alias("chars"),
                      F.lit(False).alias("has_error"), F.lit(False).alias("has_warning"),
                      F.lit(False).alias("flags_checked"))
    return k.unionByName(n)


def log_file_count(keys: DataFrame, nested: DataFrame) -> DataFrame:
    """Files analysed per incident."""
    both = keys.select("incident_id").unionByName(nested.select("incident_id"))
    return both.groupBy("incident_id").agg(F.count(F.lit(1)).alias("files_analyzed"))


def file_analysis_text(keys: DataFrame, nested: DataFrame) -> DataFrame:
    """P23 as text: ``Log File Analysis:`` with ``- file: N characters`` and
    error / warning indicator lines for key files (fixed file order), then
    ``Additional Logs Analysis:`` with sizes of nested logs."""
    low = F.lower(F.col("content"))
    order = F.lpad(F.array_position(F.array(*[F.lit(x) for x in K.KEY_LOG_FILES]), F.col("file_name"))
                   .cast("string"), 3, "0")
    k = keys.select("incident_id", F.lit(1).alias("sec"), order.alias("o"), F.concat_ws(
        "\n", F.concat(F.lit("- "), F.col("file_name"), F.lit(": "), F.length("content").cast("string"),
                       F.lit(" characters")),
        F.when(low.contains("error") | low.contains("fail"), F.lit("  Contains error indicators")),
        F.when(low.contains("warn"), F.lit("  Contains warning indicators"))).alias("txt"))
    n = nested.select("incident_id", F.lit(3).alias("sec"), F.col("file_name").alias("o"),
                      F.concat(F.lit("- "), F.col("file_name"), F.lit(": "), F.length("content").cast("string"),
                               F.lit(" characters")).alias("txt"))
    hk = k.select("incident_id").distinct().select("incident_id", F.lit(0).alias("sec"), F.lit("").alias("o"),
                                                   F.lit("Log File Analysis:").alias("txt"))
    hn = n.select("incident_id").distinct().select("incident_id", F.lit(2).alias("sec"), F.lit("").alias("o"),
                                                   F.lit("\nAdditional Logs Analysis:").alias("txt"))
    parts = hk.unionByName(k).unionByName(hn).unionByName(n)
    agg = parts.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("sec", "o", "txt"))).alias("_xs"))
    return agg.select("incident_id", F.array_join(F.transform("_xs", lambda x: x["txt"]), "\n").alias("file_analysis"))


def logs_prompt_content(keys: DataFrame, nested: DataFrame, summaries: DataFrame | None = None,
                        github: DataFrame | None = None) -> DataFrame:
    """Ordered prompt sections per incident -- summary (1000), the three
    prompt key files (500 each), nested logs (300 each), the first message
    mentioning github.com (``github``: incident_id, ts, pos, content), and the
    file analysis text."""
    def cap(c, n):
        return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)

    path = F.concat(F.col("incident_id"), F.lit("/"), F.col("date_folder"), F.lit("/"), F.col("analyzer_folder"))
    # key files in their fixed order, nested logs by name
    order = F.lpad(F.array_position(F.array(*[F.lit(x) for x in K.LOG_PROMPT_FILES]), F.col("file_name"))
                   .cast("string"), 3, "0")
    k = keys.filter(F.col("file_name").isin(*K.LOG_PROMPT_FILES)).select(
        "incident_id", F.lit(1).alias("sec"), order.alias("o"),
        F.concat(F.lit("\nFILE: "), F.col("file_name"), F.lit("\nPATH: "), path, F.lit("/"), F.col("file_name"),
                 F.lit("\nCONTENT:\n"), cap(F.col("content"), 500)).alias("txt"))
    n = nested.select(
        "incident_id", F.lit(3).alias("sec"), F.col("file_name").alias("o"),
        F.concat(F.lit("\nFILE: "), F.col("file_name"), F.lit("\nPATH: "), path, F.lit("/"), F.col("file_name"),
                 F.lit("\nCONTENT:\n"), cap(T.tail(F.col("content"), K.LOG_TAIL_CAP), 300)).alias("txt"))
    # headers for the two file sections
    hk = k.select("incident_id").distinct().select("incident_id", F.lit(0).alias("sec"), F.lit("").alias("o"),
                                                   F.lit("\nKEY LOG FILES:").alias("txt"))
    hn = n.select("incident_id").distinct().select("incident_id", F.lit(2).alias("sec"), F.lit("").alias("o"),
                                                   F.lit("\nADDITIONAL LOGS:").alias("txt"))
    fa = file_analysis_text(keys, nested).select(
        "incident_id", F.lit(5).alias("sec"), F.lit("").alias("o"),
        F.concat(F.lit("\nCOMPREHENSIVE FILE ANALYSIS:\n"), F.col("file_analysis")).alias("txt"))
    parts = hk.unionByName(k).unionByName(hn).unionByName(n).unionByName(fa)
    if github is not None:
        first = F.min(F.when(F.lower(F.col("content")).contains("github.com"), F.struct("ts", "pos", "content")))
        g = (github.groupBy("incident_id").agg(first["content"].alias("_g")).filter(F.col("_g").isNotNull())
             .select("incident_id", F.lit(4).alias("sec"), F.lit("").alias("o"),
                     F.concat(F.lit("\nGITHUB REFERENCE:\n"), F.col("_g")).alias("txt")))
        parts = parts.unionByName(g)
    if summaries is not None:
        s = summaries.filter(F.coalesce(F.col("summary"), F.lit("")) != "").select(
            "incident_id", F.lit(-1).alias("sec"), F.lit("").alias("o"),
            F.concat(F.lit("INCIDENT SUMMARY:\n"), cap(F.col("summary"), 1000)).alias("txt"))
        parts = s.unionByName(parts)
    agg = parts.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("sec", "o", "txt"))).alias("_xs"))
    return agg.select("incident_id", F.array_join(F.transform("_xs", lambda x: x["txt"]), "\n").alias("logs_content"))
