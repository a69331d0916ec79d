"""Page exports: a folder of four files for each document and parser, checked as a relation before anything reads it.

The files of (folder, name, content) are compared with each other and, where there is one, with a pinned manifest.
Every check has a name; `load` gives pages only if no export has a problem.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FILES = ("pages.json", "metadata.json", "document.md", "run.json")
PAGES = "schema_version int, page_numbering string, parser string, source_sha256 string, pages array<struct<page:int,markdown:string,text_chars:long>>"
METADATA = "parser string, source struct<id:string,sha256:string,pages:int,metadata:struct<title:string>>"
RUN = "parser string, document string, input_sha256 string, status string, expected_pages int, parsed_pages int, nonempty_pages int, document_sha256 string"
NUMBERING = "1-based physical PDF pages"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, content) of the files two levels below a path; a file is one row."""
    rows = spark.read.option("pathGlobFilter", "*.{json,md}").text(f"{path}/*", wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), F.col("value").alias("content"))


def digest(content: Column) -> Column:
    """SHA-256 of the content with line feeds only, as any checkout has it."""
    return F.sha2(F.regexp_replace(content, "\r\n", "\n").cast("binary"), 256)


def opened(files_: DataFrame) -> DataFrame:
    """(folder, p, m, r, document, hashes, names): the parsed files of each folder; what doesn't parse is null."""
    of = lambda n: F.max(F.when(F.col("name") == n, F.regexp_replace("content", "\r\n", "\n"))).alias(n.split(".")[0])
    held = files_.filter(F.col("name").isin(*FILES)).groupBy("folder").agg(*map(of, FILES), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", digest(F.col("content")).alias("sha256"))))).alias("hashes"), F.count("*").alias("n_files"))
    return held.select("folder", F.from_json("pages", PAGES).alias("p"), F.from_json("metadata", METADATA).alias("m"), F.from_json("run", RUN).alias("r"), "document", "hashes", "n_files")


def joined_pages(pages: Column) -> Column:
    return F.array_join(F.transform(pages, lambda x: F.concat(F.lit("<!-- source page "), x["page"].cast("string"), F.lit(" -->\n\n"), x["markdown"])), "\n\n")


def checked(files_: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """(folder, parser, document_id, source_sha256, title, pages, problems): an export of each folder of files.

    ``manifest`` has (folder, parser, document_id, source_sha256, sha256_utf8_lf map of file name to digest); a folder
    that it names and that has no files is a problem too.
    """
    rows = opened(files_)
    if manifest is not None:
        pinned = manifest.select("folder", F.struct("parser", "document_id", "source_sha256", "sha256_utf8_lf").alias("x"))
        rows = rows.join(pinned, "folder", "full")
    else:
        rows = rows.withColumn("x", F.lit(None).cast("struct<parser:string,document_id:string,source_sha256:string,sha256_utf8_lf:map<string,string>>"))
    p, m, r, x = map(F.col, "pmrx")
    n = F.size(p["pages"])
    differ = lambda *cs: F.coalesce(F.greatest(*[cs[0] != c for c in cs[1:]], F.lit(False)), F.lit(True))
    numbered = F.transform(p["pages"], lambda y: y["page"])
    content = joined_pages(p["pages"])
    if_pinned = lambda c: x.isNotNull() & F.coalesce(c, F.lit(True))
    unread = (F.coalesce("n_files", F.lit(0)) != len(FILES)) | p["pages"].isNull() | m["source"].isNull() | r["status"].isNull()
    told = {
        "missing or unreadable file": unread,
        "not in the manifest": F.lit(manifest is not None) & x.isNull(),
        "pinned hash mismatch": if_pinned(F.greatest(*[~F.col("hashes")[f].eqNullSafe(x["sha256_utf8_lf"][f]) for f in FILES])),
        "parser identity mismatch": differ(p["parser"], m["parser"], r["parser"]),
        "unsupported page contract": (p["schema_version"] != 1) | (p["page_numbering"] != NUMBERING) | p["schema_version"].isNull() | p["page_numbering"].isNull(),
        "source hash mismatch": differ(m["source"]["sha256"], p["source_sha256"], r["input_sha256"]),
        "invalid source hash": ~F.coalesce(m["source"]["sha256"].rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "document identity mismatch": differ(m["source"]["id"], r["document"]),
        "page count mismatch": differ(n, m["source"]["pages"], r["expected_pages"], r["parsed_pages"]) | (n == 0),
        "missing, duplicate or unordered page": (n > 0) & (numbered != F.sequence(F.lit(1), F.greatest(n, F.lit(1)))),
        "incomplete run": differ(r["status"], F.lit("success")) | differ(r["nonempty_pages"], F.size(F.filter(p["pages"], lambda y: y["text_chars"] > 0))),
        "page text differs from document": differ(content, F.col("document")) | differ(F.sha2(content.cast("binary"), 256), r["document_sha256"]),
        "pinned identity mismatch": if_pinned(differ(x["parser"], p["parser"]) | differ(x["document_id"], m["source"]["id"]) | differ(x["source_sha256"], m["source"]["sha256"])),
    }
    # A file that can't be read makes every other check moot.
    rest = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in list(told.items())[1:]]))
    problems = F.when(unread, F.array(F.lit("missing or unreadable file"))).otherwise(rest)
    return rows.select("folder", F.coalesce(p["parser"], x["parser"]).alias("parser"), F.coalesce(m["source"]["id"], x["document_id"]).alias("document_id"), m["source"]["sha256"].alias("source_sha256"), F.coalesce(m["source"]["metadata"]["title"], F.lit("")).alias("title"), p["pages"].alias("pages"), problems.alias("problems"))


def matrix_problems(exports: DataFrame, parsers: list[str]) -> DataFrame:
    """(document_id, problem): a document that a parser read twice or not at all, or whose source differs by parser."""
    per = exports.groupBy("document_id", "parser").agg(F.count("*").alias("n"), F.min(F.struct("source_sha256", F.size("pages"))).alias("low"), F.max(F.struct("source_sha256", F.size("pages"))).alias("high"))
    whole = per.filter(F.col("parser").isin(*parsers)).groupBy("document_id").agg(F.count("*").alias("n"), F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"))
    problems = F.array_compact(F.array(F.when(F.col("most") > 1, "duplicate input"), F.when(F.col("n") < len(parsers), "missing parser"), F.when(F.col("low") != F.col("high"), "source differs by parser")))
    known = exports.select("document_id").distinct().join(whole, "document_id", "left")
    return known.select("document_id", F.explode(F.when(F.col("n").isNull(), F.array(F.lit("missing parser"))).otherwise(problems)).alias("problem"))


def load(exports: DataFrame) -> DataFrame:
    """(document_id, parser, page, markdown, text_chars) of `checked` exports; any problem is an error that names it."""
    if wrong := exports.filter(F.size("problems") > 0).select("folder", "problems").head(1):
        raise ValueError(f"{wrong[0]['folder']}: {', '.join(wrong[0]['problems'])}")
    return exports.select("document_id", "parser", F.explode("pages").alias("p")).select("document_id", "parser", "p.*")


def sparse(pages: DataFrame, expected: DataFrame, document: str, page: str, markdown: str, n: str) -> DataFrame:
    """(document, content, unprocessed): pages that were read under their physical numbers, and those that weren't."""
    done = pages.groupBy(document).agg(F.array_sort(F.collect_list(F.struct(F.col(page).cast("int").alias("page"), F.col(markdown).alias("markdown")))).alias("p"))
    out = expected.select(document, n).join(done, document, "left")
    all_ = F.when(F.col(n) > 0, F.sequence(F.lit(1), F.col(n).cast("int"))).otherwise(F.array().cast("array<int>"))
    got = F.coalesce(F.transform("p", lambda x: x["page"]), F.array().cast("array<int>"))
    return out.select(document, F.coalesce(joined_pages(F.col("p")), F.lit("")).alias("content"), F.array_except(all_, got).alias("unprocessed"))


def resumed(checkpoints: DataFrame, keys: list[str], content: str, sha256: str) -> DataFrame:
    """Adds ``problem`` to page checkpoints of all sources: a page whose content isn't what its digest says, or that
    comes twice, must not be resumed from."""
    twice = F.count("*").over(Window.partitionBy(*keys)) > 1
    bad = ~(digest(F.col(content)) == F.col(sha256)) | F.col(content).isNull() | F.col(sha256).isNull()
    return checkpoints.withColumn("problem", F.when(bad, "hash mismatch").when(twice, "duplicate page"))


def chunk_problems(index: DataFrame, chunk_files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(strategy, problem): a chunk file that isn't the one of the index (path, digest), or chunks of another strategy or
    tokenizer.  ``index`` has (strategy, path, sha256_utf8_lf, tokenizer), ``chunk_files`` (strategy, path, content)."""
    met = index.alias("i").join(chunk_files.alias("f"), "strategy", "left")
    found = met.select("strategy", F.explode(F.array_compact(F.array(
        F.when(F.col("f.content").isNull(), "missing chunk file"), F.when(F.col("f.path") != F.col("i.path"), "unexpected path"),
        F.when(digest(F.col("f.content")) != F.col("i.sha256_utf8_lf"), "hash mismatch")))).alias("problem"))
    other = chunks.join(index.select("strategy", F.col("tokenizer").alias("__t")), "strategy", "left").filter("__t is null or tokenizer is null or tokenizer <> __t")
    return found.unionByName(other.select("strategy", F.lit("strategy or tokenizer mismatch").alias("problem")).distinct())


def cached(requests: DataFrame, identity: list[str], cache: DataFrame) -> DataFrame:
    """Adds ``cache_key``, the digest of the canonical identity, and ``response``, that of the (cache_key, response) cache
    if it holds one.  Equal requests have one key, however their columns are ordered."""
    key = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(identity)]), {"ignoreNullFields": "false"}), 256)
    return requests.withColumn("cache_key", key).join(cache.select("cache_key", "response"), "cache_key", "left").select(*requests.columns, "cache_key", "response")


REVIEWED = ("human_verified", "adjudicated", "excluded", "draft")


def reviewed(labels: DataFrame, decisions: DataFrame, id_col: str, sha256: str) -> DataFrame:
    """(id, review_status, reviewer, problem): labels under the decisions of reviewers.

    A decision holds for the content that was reviewed: another digest, an unknown label or status, a human status without
    a reviewer, or a second decision is a problem, and the label keeps its status.
    """
    times = decisions.withColumn("__n", F.count("*").over(Window.partitionBy(id_col)))
    d = times.select(F.col(id_col).alias("__id"), F.col("review_status").alias("__s"), F.col("reviewer").alias("__r"), F.col(sha256).alias("__h"), "__n")
    met = labels.join(d, labels[id_col].eqNullSafe(d["__id"]), "full")
    human = F.col("__s").isin("human_verified", "adjudicated")
    problem = (F.when(F.col("__n").isNull(), None).when(F.col(sha256).isNull(), "unknown label").when(F.col("__n") > 1, "several decisions").when(F.col("__h") != F.col(sha256), "reviewed content differs")
               .when(~F.coalesce(F.col("__s").isin(*REVIEWED), F.lit(False)), "unknown status").when(human & F.coalesce(F.trim("__r") == "", F.lit(True)), "no reviewer"))
    taken = F.col("__n").isNotNull() & problem.isNull()
    return met.select(F.coalesce(labels[id_col], d["__id"]).alias(id_col), F.when(taken, F.col("__s")).otherwise(F.col("review_status")).alias("review_status"), F.when(taken, F.col("__r")).alias("reviewer"), problem.alias("problem")).distinct()


def ordered_blocks(layout: Column) -> Column:
    """The text of layout blocks (array of struct<order,text>) in reading order; blocks without an order come last."""
    placed = F.transform(layout, lambda b, i: F.struct(F.coalesce(b["order"].cast("int"), F.lit(99_999)).alias("o"), i.alias("i"), b["text"].alias("text")))
    return F.array_join(F.filter(F.transform(F.array_sort(placed), lambda b: b["text"]), lambda t: F.trim(t) != ""), "\n\n")
