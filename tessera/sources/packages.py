"""Packages and files from a landing zone: archives are read as rows of bytes and opened safely, files are found by path and judged by their first bytes."""

from __future__ import annotations

import hashlib
import io
import posixpath
import stat
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_FILES, MOST_BYTES = 10_000, 200 << 20
PYPI_NAME, NPM_NAME = r"^(?i:[0-9a-z]|[0-9a-z][-0-9_.a-z]*[0-9a-z])$", r"^(?:@[0-9a-z][-0-9_.a-z]*/)?[0-9a-z][-0-9_.a-z]*$"


def valid_name(name: Column, ecosystem: Column) -> Column:
    return F.when(F.lower(ecosystem) == "npm", F.trim(name).rlike(NPM_NAME)).otherwise(F.trim(name).rlike(PYPI_NAME))


def safe_url(url: Column, hosts: list[str]) -> Column:
    """https, a host of the list or under one of it, no user, and no literal address of a private, local or reserved range."""
    parts = r"^(?i)https://([^/?#@:\[\]]+)(?::[0-9]+)?(?:[/?#]|$)"
    host = F.lower(F.regexp_extract(url, parts, 1))
    listed = F.lit(False)
    for h in hosts:
        listed = listed | (host == h.lower()) | F.endswith(host, F.lit("." + h.lower().lstrip(".")))
    private = r"^(0|10|127|169\.254|192\.168|172\.(1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9])\."
    return F.coalesce(url.rlike(parts) & listed & ~host.rlike(private) & ~host.rlike(r"^(localhost|.*\.local)$"), F.lit(False))


def archive_url(meta: DataFrame) -> DataFrame:
    """Registry metadata (package, ecosystem, j) -> the archive to be fetched and its digest: of PyPI's files the first source archive, else the first wheel;
    npm's tarball."""
    files = F.from_json(F.get_json_object("j", "$.urls"), "array<struct<packagetype:string,url:string,digests:struct<sha256:string>>>")
    first = lambda kind: F.element_at(F.filter(files, lambda x: x["packagetype"] == kind), 1)
    safe = lambda kind: F.when(F.size(F.filter(files, lambda x: x["packagetype"] == kind)) > 0, first(kind))
    chosen = F.coalesce(safe("sdist"), safe("bdist_wheel"))
    npm = F.lower("ecosystem") == "npm"
    url = F.when(npm, F.get_json_object("j", "$.dist.tarball")).otherwise(chosen["url"])
    digest = F.when(npm, F.get_json_object("j", "$.dist.shasum")).otherwise(chosen["digests"]["sha256"])
    return meta.select("package", "ecosystem", url.alias("url"), digest.alias("digest"))


def _safe(name: str) -> str | None:
    """A member's path below the root, or None if it would leave it."""
    if name.startswith(("/", "\\")) or "\0" in name or (len(name) > 1 and name[1] == ":"):
        return None
    path = posixpath.normpath(name.replace("\\", "/"))
    return None if path == ".." or path.startswith("../") else path


def members(data: bytes, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> list[tuple[str, bytes | None, str]]:
    """(path, content, status) of an archive's files: links and paths that leave the root are refused, and so is an archive beyond the bounds, counted as its
    bytes come out. Whatever can't be opened gives one row that says so."""
    out, size = [], 0
    try:
        if data[:2] == b"PK":
            z = zipfile.ZipFile(io.BytesIO(data))
            entries = [(i.filename, stat.S_ISLNK(i.external_attr >> 16), lambda i=i: z.open(i)) for i in z.infolist() if not i.is_dir()]
        else:
            t = tarfile.open(fileobj=io.BytesIO(data))  # noqa: SIM115
            entries = [(i.name, not i.isfile(), lambda i=i: t.extractfile(i)) for i in t.getmembers() if not i.isdir()]
        if len(entries) > most_files:
            return [("", None, "too many files")]
        for name, link, read in entries:
            path = _safe(name)
            if link or path is None:
                out.append((name, None, "refused"))
                continue
            content = read().read(most_bytes - size + 1)
            size += len(content)
            if size > most_bytes:
                return [("", None, "too large")]
            out.append((path, content, "completed"))
    except (OSError, EOFError, ValueError, RuntimeError, zipfile.BadZipFile, tarfile.TarError) as e:
        return [("", None, f"error: {type(e).__name__}")]
    return out


def opened(archives: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """archives (package, data, digest) -> (package, path, content, status); an archive whose sha256 or sha1 isn't the digest is refused as a whole."""

    def one(data: bytes, digest: str | None) -> list[tuple]:
        if digest and digest.lower() not in (hashlib.sha256(data).hexdigest(), hashlib.sha1(data).hexdigest()):  # noqa: S324 - npm's shasum
            return [("", None, "digest differs")]
        return members(data, most_files, most_bytes)

    def go(frames):
        for f in frames:
            for package, data, digest in zip(f["package"], f["data"], f["digest"]):
                yield pd.DataFrame([(package, *x) for x in one(bytes(data), digest)], columns=["package", "path", "content", "status"])

    return archives.select("package", "data", "digest").mapInPandas(go, "package string, path string, content binary, status string")


def results(files: DataFrame, findings: DataFrame, errors: DataFrame) -> DataFrame:
    """One row for each package of files (package, ecosystem, path): files, findings that aren't SAFE, status and is_safe. No findings and errors (package): the scan
    says nothing, so is_safe is null."""
    n = F.count(F.lit(1))
    scanned = files.groupBy("package", "ecosystem").agg(n.alias("files_scanned"))
    found = findings.filter(F.upper("severity") != "SAFE").groupBy("package").agg(n.alias("total_findings"))
    failed = errors.groupBy("package").agg(n.alias("errors"))
    both = scanned.join(found, "package", "left").join(failed, "package", "left").fillna(0, ["total_findings", "errors"])
    status = F.when((F.col("total_findings") == 0) & (F.col("errors") > 0), "error").otherwise("completed")
    count_key = F.when(F.col("ecosystem") == "pypi", "python_files_scanned").when(F.col("ecosystem") == "npm", "js_files_scanned").otherwise(F.concat("ecosystem", F.lit("_files_scanned")))
    return both.select("package", "ecosystem", "files_scanned", count_key.alias("count_key"), "total_findings", status.alias("scan_status"), F.when(status == "completed", F.col("total_findings") == 0).alias("is_safe"))


# Files.

TEXT_EXTENSIONS = ("txt", "md", "rst", "py", "js", "ts", "json", "yaml", "yml", "toml", "csv", "html", "css", "xml", "go", "rs", "rb", "java", "c", "h", "cfg", "ini", "log")
DANGEROUS = ("exe", "dll", "so", "dylib", "bin", "msi", "apk", "jar", "class", "pyc", "scr", "bat", "cmd", "ps1", "vbs", "zip", "tar", "gz", "7z", "rar", "iso", "dmg", "doc", "docm", "xlsm", "pdf")
MAGIC = [
    ("89504E470D0A1A0A", "image"), ("47494638", "image"), ("FFD8FF", "image"), ("424D", "image"), ("25504446", "application"), ("504B0304", "application"), ("1F8B", "application"), ("7F454C46", "application"), ("4D5A", "application"),
    ("CAFEBABE", "application"), ("377ABCAF271C", "application"), ("52617221", "application"), ("4F676753", "audio"), ("494433", "audio"), ("664C6143", "audio"), ("1A45DFA3", "video"), ("3C3F786D6C", "text"), ("EFBBBF", "text"),
]


def magic(data: Column) -> Column:
    """The family that the first bytes show: text, image, audio, video or application; unknown without a signature."""
    head = F.hex(F.substring(data, 1, 12))
    out = F.lit("unknown")
    for sign, family in reversed(MAGIC):
        out = F.when(F.startswith(head, F.lit(sign)), family).otherwise(out)
    riff = F.substring(head, 17, 8)
    out = F.when(F.startswith(head, F.lit("52494646")), F.when(riff == "57415645", "audio").when(riff == "41564920", "video").when(riff == "57454250", "image").otherwise("application")).otherwise(out)
    return F.when(F.substring(head, 9, 8) == "66747970", "video").otherwise(out)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(?:^|/)[^/]+\.([^./]+)$", 1))


def looked_up(path: Column, data: Column) -> Column:
    """Whether a file goes to the lookup service: a text extension only if its bytes disagree, a dangerous one always, any other if its bytes aren't text."""
    other = ~magic(data).isin("text", "unknown")
    return F.when(extension(path).isin(*TEXT_EXTENSIONS), other).when(extension(path).isin(*DANGEROUS), True).otherwise(other)


def discovered(paths: DataFrame, most: int = 10) -> DataFrame:
    """All regular files (path, real: what links lead to, root) outside of caches and hidden folders and not led out of the root, by path, and whether each is
    among the first `most` (0: all are)."""
    inside = F.startswith(F.coalesce("real", "path"), F.concat(F.rtrim("root", F.lit("/")), F.lit("/")))
    kept = paths.filter(inside & ~F.col("path").rlike(r"(^|/)(\.[^/]+|__pycache__)(/|$)"))
    if not most:
        return kept.select("path", F.lit(True).alias("chosen")).orderBy("path")
    first = kept.select("path").orderBy("path").limit(most).withColumn("chosen", F.lit(True))
    return kept.select("path").join(first, "path", "left").select("path", F.coalesce("chosen", F.lit(False)).alias("chosen")).orderBy("path")


def prefiltered(files: DataFrame, markers: str, most_bytes: int = 5 << 20) -> DataFrame:
    """files (path, content, n_bytes) worth parsing: with a marker and not too large. A file that couldn't be read (null content) stays, to be reported."""
    return files.filter(F.col("content").isNull() | ((F.col("n_bytes") <= most_bytes) & F.col("content").rlike(markers)))
