"""Secret scans by ownership frequency, in DataFrame functions only: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areasignal.llm.common import written

# The patterns of the base kinds, and public formats of credentials.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VENDOR = (
    r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35,}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+|-----BEGIN [A-Z ]*PRIVATE KEY-----)"
)
SAMPLE = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test|1234567890|abcdefgh"
#: Kinds in the order of ties: those of the base, then the method's own.
KINDS = ("assign", "access", "hex", "vendor", "live")
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "vendor": VENDOR}
#: What a text has at least one match of if it has a match of any pattern.
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|gh[pousr]_|xox[abprs]-|[sr]k_live_|AIza|eyJ|-----BEGIN "


def _looks(v: Column) -> Column:
    """Whether a value is long and mixed enough for a credential and has no sample word in it."""
    return (F.length(v) >= 16) & (F.size(F.array_distinct(F.split(v, ""))) >= 8) & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~v.rlike(SAMPLE)


#: Of a match: its kind, the characters between it and the one before, those of it and of its value, the value's hash and looks.
_MATCH = "array<struct<kind:int,gap:int,size:int,long:int,hash:string,looks:boolean>>"


def _matches(text: Column, kind: str) -> Column:
    """All matches of a kind; a value itself is never written, only its hash."""
    found, between = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)
    value = (lambda m: F.regexp_extract(m, ASSIGN, 2)) if kind == "assign" else (lambda m: m)
    return F.transform(found, lambda m, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.length(F.get(between, i)).alias("gap"), F.length(m).alias("size"), F.length(value(m)).alias("long"), F.sha2(value(m), 256).alias("hash"), (_looks(value(m)) | F.lit(kind == "vendor")).alias("looks")))


def candidates(df: DataFrame, key: list[Column], text_col: str, source_col: str) -> DataFrame:
    """key columns (by their aliases), source, row (a number, stable as the table is written) and matches."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    matches = F.when(text.rlike(ANY), F.concat(*(_matches(text, k) for k in PATTERNS)).cast(_MATCH)).otherwise(F.array().cast(_MATCH))
    return written(df.select(*key, F.col(source_col).cast("string").alias("__source"), matches.alias("__matches")).withColumn("__row", F.monotonically_increasing_id()), narrow=True)


def judged(rows: DataFrame, max_owners: int = 2, max_repos: int = 4) -> DataFrame:
    """A row for each span of candidates' rows: __row, kind, start, end, from (code points), owners, repos, live, example.

    Owners (the part of a source before its first slash) and repositories (whole sources) of each value's hash are counted
    apart over the whole corpus. A value of more owners than max_owners, or in more repositories than max_repos though its
    owners be few, is a copied example, such as a template's; one of fewer that looks like a credential is live.
    """
    one = rows.where(F.size("__matches") > 0).select("__row", "__source", F.posexplode("__matches").alias("at", "m")).select("__row", "__source", "at", "m.*")
    before = Window.partitionBy("__row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    one = one.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).where("kind <> 0 or long >= 6")
    repo = F.coalesce("__source", F.lit(""))
    found = written(one.select("__row", "kind", "start", "end", "long", "hash", "looks", repo.alias("repo"), F.substring_index(repo, "/", 1).alias("owner")))
    copies = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    owned = written(copies.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")))
    own = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    return found.join(owned, "hash").select("__row", "kind", "start", "end", (F.col("end") - F.col("long")).alias("from"), "owners", "repos", (own & F.col("looks")).alias("live"), (~own).alias("example"))


def _text_of(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_owners: int = 2, max_repos: int = 4) -> DataFrame:
    """A row for each input row: id_col, found (array of structs start, kind, end; sorted), base (the same of base kinds),
    ownership (for each base and vendor match start, kind, end, owners, repos, live), n_assign, n_access, n_hex, n_live,
    n_example.

    Spans are in code points, the end exclusive; kinds are numbered as KINDS. A null text is empty and has none; a null
    source is one unnamed owner and repository; repeated rows have equal results. Other columns don't matter. The rows of a
    value that a third of the corpus has are counted by partial aggregation and joined by a join that Spark can split.
    """
    rows = candidates(df, [F.col(id_col).alias("__id")], text_col, source_col)
    spans = judged(rows, max_owners, max_repos)
    entry = lambda kind, start, *more: F.struct(F.col(start).cast("long").alias("start"), kind.cast("int").alias("kind"), F.col("end").cast("long").alias("end"), *more)
    by = spans.groupBy("__row").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") < 3, entry(F.col("kind"), "start")))).alias("base"),
        F.array_sort(F.array_distinct(F.concat(F.collect_list(entry(F.col("kind"), "start")), F.collect_list(F.when(F.col("live"), entry(F.lit(4), "from")))))).alias("found"),
        F.array_sort(F.collect_list(entry(F.col("kind"), "start", F.col("owners"), F.col("repos"), F.col("live")))).alias("ownership"),
        *(F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(3)), F.count_if("live").alias("n_live"), F.count_if("example").alias("n_example"),
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    unjudged = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,owners:bigint,repos:bigint,live:boolean>>")
    counts = ("n_assign", "n_access", "n_hex", "n_live", "n_example")
    found = rows.select("__id", "__row").join(by, "__row", "left")
    return found.select(F.col("__id").alias(id_col), F.coalesce("base", none).alias("base"), F.coalesce("found", none).alias("found"), F.coalesce("ownership", unjudged).alias("ownership"), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return _text_of(spans)


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_owners: int = 2, max_repos: int = 4, mark: str = "<SECRET>") -> DataFrame:
    """df with the live spans of each text replaced by the mark; all else, and all copied examples, stay as they are.

    Only rows that match any pattern are joined with their spans, by id and a hash of the text. Columns are told apart by
    their place, so any names may stand in df.
    """
    names = [f"__{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    key, text, source = (names[df.columns.index(c)] for c in (id_col, text_col, source_col))
    t = F.col(text)
    body, some_match = F.xxhash64(F.coalesce(t, F.lit(""))), F.coalesce(t.rlike(ANY), F.lit(False))
    some = plain.where(some_match)
    rows = candidates(some, [F.col(key).alias("__id"), body.alias("__body")], text, source)
    live = judged(rows, max_owners, max_repos).where("live").select("__row", F.struct(F.col("from").cast("int").alias("from"), F.col("end").cast("int").alias("end")).alias("s"))
    by = rows.select("__row", "__id", "__body").join(live, "__row").groupBy("__id", "__body").agg(F.array_sort(F.collect_set("s")).alias("__spans"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        add = F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["from"] - acc["at"]), F.lit(mark))
        return F.when(s["from"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), add.alias("out")))

    end = lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t)))
    joined = some.join(by, F.col(key).eqNullSafe(F.col("__id")) & (body == F.col("__body")), "left")
    done = joined.withColumn(text, F.when(F.col("__spans").isNull(), t).otherwise(F.aggregate("__spans", start, step, end))).select(*names)
    return plain.where(~some_match).union(done).toDF(*df.columns)
