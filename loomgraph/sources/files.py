"""Files and their routes: decoding, path rules, sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings tried for East Asian text, and texts that mean nothing.
EAST_ASIAN = ["gb18030", "gbk", "big5", "shift_jis"]
NOTHING = ["", "none", "null", "{}", "[]"]
# Routes of files by suffix and name; parameters of ``route_files``.
BLOCKED = ["node_modules", ".git", "__pycache__", "dist", "build", ".venv", "venv", "target", "vendor"]
SECRETS = r"(^|/)(\.env[^/]*|id_rsa[^/]*|[^/]*\.(pem|key|p12|pfx|keystore))$"
LOCKS = r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|cargo\.lock|go\.sum|uv\.lock|[^/]*\.lock)$"
RESERVED = r"(?i)(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/]*)?(/|$)"
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "java": "java", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "bash", "sql": "sql"}
BINARY = ["png", "jpg", "jpeg", "gif", "webp", "ico", "zip", "gz", "tar", "7z", "rar", "exe", "dll", "so", "dylib", "bin", "class", "jar", "woff", "woff2", "ttf", "mp3", "mp4", "avi", "mov", "sqlite", "db", "pyc"]


def decoded(raw: bytes) -> tuple[str | None, str | None, int, str | None]:
    """(text, encoding, replacement characters, reason of rejection): by mark, then UTF-8, then the best East Asian one, then Western."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            text, encoding = raw.decode(name, "replace"), name
            break
    else:
        if b"\0" in raw:
            return None, None, 0, "nul"
        try:
            text, encoding = raw.decode("utf-8"), "utf-8"
        except UnicodeDecodeError:
            tried = []
            for k, name in enumerate(EAST_ASIAN):
                t = raw.decode(name, "replace")
                tried.append((t.count("�"), -sum("぀" <= c <= "鿿" or "！" <= c <= "｠" for c in t) / max(len(t), 1), k, name, t))
            damage, asian, _, encoding, text = min(tried)
            if damage > len(text) * 0.01 or -asian < 0.2:
                encoding = "cp1252"
                try:
                    text = raw.decode(encoding)
                except UnicodeDecodeError:
                    encoding = "latin-1"
                    text = raw.decode(encoding)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lost = text.count("�")
    if "\0" in text:
        return None, encoding, lost, "nul"
    if sum(c < " " and c not in "\n\t\f" for c in text) > 0.01 * len(text):
        return None, encoding, lost, "control characters"
    if lost > 0.01 * len(text):
        return None, encoding, lost, "damaged"
    return (None, encoding, lost, "empty") if text.strip().lower() in NOTHING else (text, encoding, lost, None)


def decode_files(files: DataFrame) -> DataFrame:
    """(path, text, encoding, replacement_count, rejected_reason) of ``files(path, content)``; a null content is empty."""

    def run(frames):
        for f in frames:
            rows = [decoded(bytes(c) if c is not None else b"") for c in f.content]
            yield pd.DataFrame([(p, *r) for p, r in zip(f.path, rows, strict=True)], columns=["path", "text", "encoding", "replacement_count", "rejected_reason"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, encoding string, replacement_count long, rejected_reason string")


def load_text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return decode_files(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def bad_path(path: Column) -> Column:
    """Why a relative path is refused, or null."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return (
        F.when(path.isNull() | (F.trim(p) == ""), "empty").when(p.rlike(r"^(/|[A-Za-z]:)"), "absolute").when(p.rlike(r"(^|/)\.\.(/|$)"), "parent")
        .when(p.rlike(r"[\x00-\x1f\x7f]"), "control").when(p.rlike(RESERVED), "reserved")
    )


def route_files(files: DataFrame) -> DataFrame:
    """``files(path, head)`` with route, language, selected, reason; ``head`` holds up to 8 KiB of text, null if not looked at. The first rule that holds counts."""
    p = F.regexp_replace(F.lower(F.replace("path", F.lit("\\"), F.lit("/"))), r"^(\./)+", "")
    suffix = F.regexp_extract(p, r"\.([a-z0-9]+)$", 1)
    language = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), suffix)
    head = F.coalesce("head", F.lit(""))
    printable = F.length(F.regexp_replace(head, r"[^\P{C}\n\t\r]", "")) >= 0.95 * F.length(head)
    rules = [
        (F.col("bad").isNotNull(), "skip", F.concat(F.lit("bad path: "), "bad")), (F.exists(F.split(p, "/"), lambda d: d.isin(BLOCKED)), "skip", F.lit("blocked folder")),
        (p.rlike(r"(^|/)\.gitignore$"), "skip", F.lit("gitignore")), (p.rlike(SECRETS), "skip", F.lit("secret")), (p.rlike(LOCKS), "skip", F.lit("lockfile")), (suffix == "ipynb", "skip", F.lit("notebook")),
        (p.rlike(r"\.(min\.(js|css)|map)$"), "skip", F.lit("minified")), (suffix.isin(BINARY) | F.contains(head, F.lit("\0")), "skip", F.lit("binary")),
        (suffix.isin("md", "markdown", "mdx"), "markdown", F.lit("suffix")), (suffix.isin("txt", "log", "csv", "rst"), "text", F.lit("suffix")), (suffix == "pdf", "pdf", F.lit("suffix")),
        (suffix.isin("doc", "docx", "ppt", "pptx", "xls", "xlsx"), "office", F.lit("suffix")), (language.isNotNull(), "code", F.lit("suffix")), ((head != "") & printable, "text", F.lit("readable")),
    ]
    route, reason = F, F
    for holds, to, why in rules:
        route, reason = route.when(holds, to), reason.when(holds, why)
    rows = files.withColumn("bad", bad_path(F.col("path"))).withColumn("route", route.otherwise("skip")).withColumn("reason", reason.otherwise("unknown"))
    return rows.withColumn("language", F.when(F.col("route") == "code", language)).withColumn("selected", F.col("route") != "skip").drop("bad")


def write_result(df: DataFrame, path: str, kind: str = "parquet", by: str = "source_config_id") -> None:
    """Writes rows in folders by source; a null source is a folder of its own."""
    if kind not in ("parquet", "json"):
        raise ValueError(f"no sink of kind {kind}")
    df.write.mode("overwrite").partitionBy(by).format(kind).save(path)


def load_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with the columns of ``schema``; a missing column or one of another type is an error, further columns are left out."""
    df = spark.read.parquet(path)
    have = {f.name: f.dataType for f in df.schema}
    for name, kind in spark.createDataFrame([], schema).dtypes:
        if name not in have or have[name].simpleString() != kind:
            raise ValueError(f"{path}: column {name} is {have[name].simpleString() if name in have else 'missing'}, not {kind}")
    return df.select(*[n for n, _ in spark.createDataFrame([], schema).dtypes])
