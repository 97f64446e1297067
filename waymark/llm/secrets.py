"""Secret scans over an incremental blob ledger. DataFrame operations only."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waymark.shared import shared_dir

SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Kind:
    """What a secret looks like; matches whose ``group`` has fewer than ``least`` characters are dropped.

    hint: a pattern that is in every text with a match, cheap to look for.
    """

    name: str
    pattern: str
    hint: str
    group: int = 0
    least: int = 0


# A run of the wanted length is asked for where no shorter match could hide a longer one: a match that is
# too short ends where its run of characters ends, and nothing longer begins inside it. In an assignment
# something can, so those are matched whole and dropped afterwards.
BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i)passw|secret|token|api_?key", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]{12,}", "AKIA"),
    Kind("hex", r"[0-9a-f]{32,}", r"[0-9a-f]{32}"),
)
MORE = (
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_"),
    Kind("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", "eyJ"),
    Kind("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "-----BEGIN "),
)
#: What the SQL has; of a private key only the line before it.
KINDS = BASE + MORE
_LINE = r"(?:[ \t]*+(?:\r?\n|\\r|\\n))++[ \t]*+"
_LINE_ENDS = r"""(?=[ \t]*+(?:[\r\n"']|\\[rn]|$))"""
#: A private key as a whole: to its END line if no other such line stands before, or else as far as lines of base64 (of
#: 16 characters, and a shorter last one) follow; line breaks may be escaped. Possessive, so that no long text is gone over twice.
PEM = Kind(
    "pem",
    r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END \1PRIVATE KEY-----"
    rf"|(?:[ \t]*+[A-Za-z0-9+/=]{{40,}}+)?+(?:{_LINE}(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+|[A-Za-z0-9+/=]{{16,}}+{_LINE_ENDS}))*+(?:{_LINE}[A-Za-z0-9+/=]++{_LINE_ENDS})?+)",
    "-----BEGIN ",
)
WHOLE = tuple(PEM if k.name == PEM.name else k for k in KINDS)


def may_hold(text: Column, kinds: tuple[Kind, ...] = WHOLE) -> Column:
    out = F.lit(False)
    for k in kinds:
        out = out | (F.contains(text, F.lit(k.hint)) if k.hint.replace("-", "").replace(" ", "").isalpha() else F.rlike(text, F.lit(k.hint)))
    return out


def spans_of_kind(text: Column, kind: Kind) -> Column:
    """Leftmost non-overlapping matches in code points: what a split leaves between the matches tells where each begins."""
    all_ = lambda g: F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(g))
    gaps = F.split(text, kind.pattern, -1)
    match = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(all_(0))).alias("gap"), all_(0).alias("m"), all_(kind.group).alias("g"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= kind.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(match, zero, step, lambda acc: acc["out"])
    return F.when(F.rlike(text, F.lit(kind.pattern)), found).otherwise(F.array().cast(SPANS))


def spans(text: Column, kinds: tuple[Kind, ...] = WHOLE) -> Column:
    """All spans by start, then in the order of the kinds."""
    rank = F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k.name), F.lit(i))))
    key = F.transform(F.concat(*(spans_of_kind(text, k) for k in kinds)), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(key), lambda s: F.struct(s["kind"], s["start"], s["end"])).cast(SPANS)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


LEDGER = f"blob string, rule_version string, spans {SPANS}"


def version_of(kinds: tuple[Kind, ...]) -> str:
    """Another one after any change of a rule, so that every blob is scanned again."""
    return hashlib.sha256(repr(kinds).encode()).hexdigest()[:16]


def read_ledger(spark: SparkSession, ledger: str, kinds: tuple[Kind, ...] = WHOLE) -> DataFrame:
    """blob, rule_version, spans of what the ledger holds under these rules; nothing where there is no ledger yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule_version") == version_of(kinds))


def unseen(docs: DataFrame, ledger: str, text: str = "text", kinds: tuple[Kind, ...] = WHOLE) -> DataFrame:
    """blob and text of the contents that the ledger lacks under these rules, each once; the text is null where no hint of a
    secret is in it, so only texts with one are moved to meet their copies. Copies meet in partial results first: a
    large group of them sends one row from each partition."""
    t = F.coalesce(F.col(text), F.lit(""))
    blobs = docs.select(blob_id(F.col(text)).alias("blob"), F.when(may_hold(t, kinds), t).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    return blobs.join(read_ledger(docs.sparkSession, ledger, kinds).select("blob"), "blob", "left_anti")


def extend(docs: DataFrame, ledger: str, text: str = "text", kinds: tuple[Kind, ...] = WHOLE) -> None:
    """Scans every content that the ledger lacks, once, and appends it with its findings, or with none. One scan of docs;
    Spark commits what is appended as a whole."""
    found = F.when(F.col("text").isNotNull(), spans(F.col("text"), kinds)).otherwise(F.array().cast(SPANS))
    unseen(docs, ledger, text, kinds).select("blob", F.lit(version_of(kinds)).alias("rule_version"), found.alias("spans")).write.mode("append").parquet(ledger)


#: Findings (some 100 bytes each) and blobs that have any, up to which these are broadcast.
FINDINGS = 500_000


def joined(docs: DataFrame, ledger: str, text: str = "text", kinds: tuple[Kind, ...] = WHOLE, blob: str = "blob", into: str = "spans") -> DataFrame:
    """docs with the id of its content and the content's findings in the ledger. Blobs with findings are broadcast while
    they and their findings are few; beyond that texts with a hint of a secret, which alone can have any, are moved."""
    found = read_ledger(docs.sparkSession, ledger, kinds).where(F.size("spans") > 0).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    # Two runs at a time on one ledger may both append a blob.
    found = found.groupBy("__blob").agg(F.first("__spans").alias("__spans"))
    blobs, many = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("__spans")), F.lit(0))).head()
    none = F.array().cast(SPANS)
    base = docs.withColumn(blob, blob_id(F.col(text)))
    if blobs + many <= FINDINGS:
        return base.join(F.broadcast(found), F.col(blob) == F.col("__blob"), "left").select(*docs.columns, blob, F.coalesce("__spans", none).alias(into))
    hint = may_hold(F.coalesce(F.col(text), F.lit("")), kinds)
    some = base.where(hint).join(found, F.col(blob) == F.col("__blob"), "left").select(*docs.columns, blob, F.coalesce("__spans", none).alias(into))
    return some.unionByName(base.where(~hint).select(*docs.columns, blob, none.alias(into)))


def find(docs: DataFrame, ledger: str | None = None, text: str = "text", kinds: tuple[Kind, ...] = WHOLE) -> DataFrame:
    """docs with blob and spans: the findings of its content, on every row that has it.

    The ledger, a table of every content that has been scanned under any rules, is extended by what it lacks, and then has all
    findings; a later run on the same and more documents scans only the new ones. Without a path a new ledger is begun
    in the shared folder. A null text counts as empty, a very long one is scanned whole; without findings spans
    is an empty array. Rows, ties and other columns stay; columns named blob or spans are replaced. An empty table gives none.
    """
    ledger = ledger or f"{shared_dir(docs.sparkSession)}/ledger-{uuid.uuid4()}"
    extend(docs, ledger, text, kinds)
    return joined(docs.select(*(c for c in docs.columns if c.lower() not in ("blob", "spans"))), ledger, text, kinds)


def redact(docs: DataFrame, mask: str = "[SECRET]", ledger: str | None = None, text: str = "text", kinds: tuple[Kind, ...] = WHOLE) -> DataFrame:
    """docs with every span of a secret replaced; overlapping spans become one mask. Columns, whatever their names, stay as
    they are; so do null and empty texts, and repeated rows. The ledger is used as by :func:`find`."""
    ledger = ledger or f"{shared_dir(docs.sparkSession)}/ledger-{uuid.uuid4()}"
    extend(docs, ledger, text, kinds)
    found = joined(docs, ledger, text, kinds, "__blob_id", "__found")
    t = F.col(text)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substr(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("__found", zero, step, lambda acc: F.concat(acc["out"], F.substr(t, acc["at"] + 1, F.length(t))))
    return found.select(*(F.when(F.size("__found") > 0, clean).otherwise(t).alias(c) if c == text else F.col(c) for c in docs.columns))


def listed(spans_: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _either(pattern: str) -> str:
    """The pattern with its leading words in either case, without the engine's own notion of case."""
    head, end = pattern[len("(?i)") :].split(")", 1)
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head) + ")" + end


def sql(kinds: tuple[Kind, ...] = KINDS, base: tuple[Kind, ...] = BASE) -> str:
    parts = []
    for i, k in enumerate(kinds):
        p = "'" + (_either(k.pattern) if k.pattern.startswith("(?i)") else k.pattern).replace("'", "''") + "'"
        parts.append(
            f"SELECT k, '{k.name}' AS kind, {i} AS rank, i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a, length(m[i]) AS n"
            f" FROM (SELECT k, gaps, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT k, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {k.group}) AS g FROM d)) WHERE length(g[i]) >= {k.least}"
        )
    names = ", ".join(f"'{k.name}'" for k in base)
    one = "string_agg(s, ',' ORDER BY a, rank)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT *, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT) AS s FROM ({" UNION ALL ".join(parts)})),
per AS (SELECT k, {", ".join(f"count(*) FILTER (kind = '{x.name}') AS n_{x.name}" for x in base)}, {one} FILTER (kind IN ({names})) AS b, {one} AS spans FROM found GROUP BY k)
SELECT doc_id, {", ".join(f"coalesce(n_{x.name}, 0) AS n_{x.name}" for x in base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (k)
"""
