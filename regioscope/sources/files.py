"""Files as rows: digests, magic bytes, manifests, page texts, delimited data; and the sinks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Magic bytes by extension.
MAGIC = {"pdf": "25504446", "xlsx": "504B0304", "zip": "504B0304", "rar": "52617221", "parquet": "50415231"}
#: Bidirectional control characters (marks, embeddings, isolates).
BIDI = "".join(map(chr, (0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A))))


def scan(spark: SparkSession, path: str, pattern: str = "*", whole: int = 256 << 20) -> DataFrame:
    """name, bytes, sha256 and whether the content starts as its extension says, for every file under the path.

    A name is the path below ``path``. Files of more than ``whole`` bytes are never held: the driver's JVM digests
    them in pieces, one after the other.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    root = fs.makeQualified(at).toString().rstrip("/") + "/"
    name = F.when(F.col("path").startswith(root), F.expr(f"substring(path, {len(root) + 1})")).otherwise(F.substring_index("path", "/", -1))
    ext = F.lower(F.substring_index(name, ".", -1))
    magic = F.create_map(*[F.lit(x) for kv in MAGIC.items() for x in kv])[ext]
    looks = F.when(magic.isNotNull(), F.hex("content").startswith(magic))
    held = f.where(F.col("length") <= whole).select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), looks.alias("looks_right"))
    rows = []
    fits, listed = jvm.org.apache.hadoop.fs.GlobFilter(pattern), fs.listFiles(at, True)
    while listed.hasNext():  # Spark's readers leave out empty files
        one = listed.next()
        below = one.getPath().toString().removeprefix(root)
        if not one.getLen() and fits.accept(one.getPath()) and not any(x[:1] in ("_", ".") for x in below.split("/")):
            rows.append((below, 0, hashlib.sha256(b"").hexdigest(), False if MAGIC.get(below.rsplit(".", 1)[-1].lower()) else None))
    for r in f.where(F.col("length") > whole).select("path", name.alias("name"), "length").collect():
        digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
        stream = jvm.java.security.DigestInputStream(fs.open(jvm.org.apache.hadoop.fs.Path(r.path)), digest)
        head = bytes(x for x in (stream.read() for _ in range(4)) if x >= 0).hex().upper()
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, jvm.java.io.OutputStream.nullOutputStream(), 1 << 20, True)
        starts = MAGIC.get(r.name.rsplit(".", 1)[-1].lower())
        rows.append((r.name, r.length, bytes(digest.digest()).hex(), starts and head.startswith(starts)))
    return held.unionByName(spark.createDataFrame(rows, "name string, bytes bigint, sha256 string, looks_right boolean")) if rows else held


def verify(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status of each file by a full join with the manifest."""
    m = manifest.select("name", F.col("sha256").alias("expected"))
    status = F.when(F.col("sha256").isNull(), "missing").when(F.col("expected").isNull(), "unlisted").when(F.col("sha256") != F.col("expected"), "mismatch").otherwise("ok")
    return found.select("name", "sha256").join(m, "name", "full").select("name", status.alias("status"))


def save_manifest(found: DataFrame, path: str) -> None:
    """The registry of sources is a short list: sorted JSON, written by the driver."""
    rows = {r.name: {"bytes": r.bytes, "sha256": r.sha256} for r in found.collect()}
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"sources": rows}, f, indent=1, sort_keys=True)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        rows = [(k, v["bytes"], v["sha256"]) for k, v in json.load(f)["sources"].items()]
    return spark.createDataFrame(rows, "name string, bytes bigint, sha256 string")


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """document, page, text: whole text files split at form feeds, without direction marks."""
    t = spark.read.text(path, wholetext=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("document"), F.translate("value", BIDI, "").alias("t"))
    return t.select("document", F.posexplode(F.split("t", "\f")).alias("page", "text")).select("document", (F.col("page") + 1).cast("bigint").alias("page"), "text")


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Delimited text with an explicit schema; an empty field is null, a quoted empty one is empty."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_dataset(df: DataFrame, path: str, gzip: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """Both published forms: Parquet and CSV (compressed on demand)."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/parquet")
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(f"{path}/csv")


def content_hash(df: DataFrame) -> str:
    """Digest of the rows whatever their order or files: what byte identity is for a single file."""
    row = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)").alias("h")).agg(F.sum("h").alias("s"), F.count("*").alias("n")).first()
    return f"{row.n}-{row.s or 0}"


def codebook(df: DataFrame, name: str, title: str, intro: str, codes: dict[str, dict] | None = None) -> str:
    """Markdown from the schema's metadata (unit, origin, description) with one count."""
    lines = [f"# {title}", "", intro, "", f"`{name}`: {df.count()} rows, {len(df.columns)} columns", "", "| column | type | unit | origin | description |", "|---|---|---|---|---|"]
    for f in df.schema.fields:
        m = f.metadata or {}
        lines.append(f"| {f.name} | {f.dataType.simpleString()} | {m.get('unit', '')} | {m.get('origin', '')} | {m.get('description', '')} |")
    for column, book in (codes or {}).items():
        lines += ["", f"## {column}", "", "| code | label |", "|---|---|", *[f"| {k} | {v} |" for k, v in sorted(book.items())]]
    return "\n".join(lines) + "\n"


def described(df: DataFrame, metadata: dict[str, dict]) -> DataFrame:
    """Attaches unit, origin and description to columns."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata=metadata[c]) if c in metadata else F.col(f"`{c}`") for c in df.columns])
