"""Listings of files: where they come from, what is left out, one row a file however it was reached, what format a head tells."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of images by default, and folders that a walk passes over, in lower case, with what others of them begin with.
EXTENSIONS = (
    "jpg", "jpeg", "jpe", "jfif", "jif", "jfi", "pjpeg", "pjp", "jpg_large", "jpg_orig", "png", "apng", "png_large", "gif", "webp", "bmp", "dib", "tif", "tiff", "avif", "avifs", "heic",
    "heics", "heif", "hif", "jxl", "ico", "pnm", "pbm", "pgm", "ppm", "pam", "tga", "qoi", "exr", "hdr", "ff",
)
SET_ASIDE = (".trash", ".trashes", "$recycle.bin", "recycler", ".thumbnails", "#recycle", "@eadir", "#snapshot", "@recycle", "@__thumb", "@recently-snapshot", "lost+found")
SET_ASIDE_BEGIN = ".trash-"
# Heads of image formats, in hex, and where they start.
SIGNATURES = (
    ("jpeg", 0, "FFD8FF"), ("png", 0, "89504E470D0A1A0A"), ("gif", 0, "474946383761"), ("gif", 0, "474946383961"), ("bmp", 0, "424D"),
    ("tiff", 0, "49492A00"), ("tiff", 0, "4D4D002A"), ("jxl", 0, "FF0A"), ("jxl", 0, "0000000C4A584C200D0A870A"), ("qoi", 0, "716F6966"),
    ("exr", 0, "762F3101"), ("farbfeld", 0, "66617262666C6564"), ("ico", 0, "00000100"),
)
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1", "avif", "avis")


def read_path_list(spark: SparkSession, path: str, null_separated: bool = False) -> DataFrame:
    """(path): one a line, or ended by NUL; carriage returns at the end and blank lines go."""
    lines = spark.read.option("lineSep", "\0" if null_separated else "\n").text(path)
    name = F.col("value") if null_separated else F.regexp_replace("value", "\r$", "")
    return lines.select(name.alias("path")).filter("path <> ''")


def root_list(spark: SparkSession, roots: Iterable[str], lists: Iterable[str] = (), null_separated: bool = False) -> DataFrame:
    found = spark.createDataFrame([(r,) for r in roots], "path string")
    for name in lists:
        found = found.union(read_path_list(spark, name, null_separated))
    return found


def list_files(spark: SparkSession, roots: list[str], side: str = "scan", recursive: bool = True) -> DataFrame:
    """(path, length, modified, side) of the files below the roots; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(roots).select("path", "length", F.col("modificationTime").alias("modified"), F.lit(side).alias("side"))


def local_listing(roots: Iterable[str], side: str = "scan", recursive: bool = True, follow: bool = False) -> list[dict]:
    """Files below local roots with what only the filesystem tells: device, inode, link, real path, depth of the root. For folders of this machine."""
    rows = []
    for root in roots:
        for folder, folders, names in os.walk(root, followlinks=follow):
            if not recursive:
                folders.clear()
            folders.sort()
            for name in sorted(names):
                path = os.path.join(folder, name)
                try:
                    stat = os.stat(path)
                except OSError:
                    rows.append({"path": path, "side": side, "broken": True})
                    continue
                rows.append({"path": path, "side": side, "broken": False, "dev": stat.st_dev, "ino": stat.st_ino, "length": stat.st_size, "modified_ns": stat.st_mtime_ns, "changed_ns": stat.st_ctime_ns, "is_link": os.path.islink(path), "real": os.path.realpath(path), "depth": os.path.realpath(root).count(os.sep)})
    return rows


def identity_dedup(files: DataFrame, identity: list[str]) -> DataFrame:
    """One row a file (identity): from the deepest root, then the scan before the library, then no link before a link, then by path."""
    best = Window.partitionBy(*identity).orderBy(F.col("depth").desc(), F.when(F.col("side") == "library", 1).otherwise(0), F.col("is_link"), F.col("path"))
    return files.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def glob_to_regex(pattern: str) -> str:
    """A pattern over path components as a regular expression: * and ? stay in a name, ** crosses names, [..] and [!..] are sets."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = pattern[i + 1 : end]
            negated = body[0] in "!^"
            out.append("[" + ("^/" if negated else "") + re.sub(r"([\\\[\]^&])", r"\\\1", body[negated:]) + "]")
            i = end + 1
            continue
        out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
        i += 1
    return "".join(out)


def matches_glob(path: Column, pattern: str) -> Column:
    """A pattern with a slash is of whole paths, one without is of any name on the way."""
    regex = glob_to_regex(pattern)
    return path.rlike(f"^{regex}$" if "/" in pattern else f"(^|/){regex}(/|$)")


def excluded(path: Column, prefixes: Iterable[str] = (), patterns: Iterable[str] = ()) -> Column:
    out = F.lit(False)
    for p in prefixes:
        p = p.rstrip("/")
        out = out | (path == p) | path.startswith(p + "/")
    for p in patterns:
        out = out | matches_glob(path, p)
    return out


def exclude_under(files: DataFrame, prefixes: DataFrame, path: str = "path") -> DataFrame:
    """Files not under any of many prefixes (prefix): a file's own prefixes are compared with them by equality. `path` may be the canonical one, for files met through links."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    hit = files.select(path, F.explode(above).alias("prefix")).join(prefixes, "prefix", "left_semi").select(path).distinct()
    return files.join(hit, path, "left_anti")


def resolve_excludes(named: DataFrame, there: DataFrame) -> DataFrame:
    """Excludes (name) with what each is: a path, if there is one of that name (there: path, canonical), then in its canonical
    form; else a pattern, if it holds a wildcard; else nothing, which is a problem."""
    met = named.join(there.select(F.col("path").alias("name"), "canonical"), "name", "left")
    kind = F.when(F.col("canonical").isNotNull(), "path").when(F.col("name").rlike(r"[*?\[]"), "pattern").otherwise("missing")
    return met.select("name", kind.alias("kind"), F.coalesce("canonical", "name").alias("means"))


def sparing(excludes: DataFrame, libraries: DataFrame) -> DataFrame:
    """Excludes (prefix) without those that would remove a whole library (root): the library itself, or a folder above it."""
    whole = F.col("root").startswith(F.concat("prefix", F.lit("/"))) | (F.col("root") == F.col("prefix"))
    # roots are what a user names: a few
    return excludes.join(F.broadcast(libraries.select("root")), whole, "left_anti")


def why_no_library(roots: DataFrame, files: DataFrame) -> DataFrame:
    """(root, reason) of library roots that gave no file: missing, the scan's own, no picture directly in it, or none at all.

    roots is (root, exists, scanned, recursive); files is (path, root, wanted: whether it would be asked).
    """
    held = files.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("wanted").cast("int")).alias("wanted"))
    met = roots.join(held, "root", "left").filter(F.coalesce("wanted", F.lit(0)) == 0)
    reason = F.when(~F.col("exists"), "it is not there").when(F.col("scanned"), "its files are among the scanned ones").when(~F.col("recursive"), "it has no picture directly in it").otherwise("it has no picture in it")
    return met.select("root", reason.alias("reason"))


def hidden(path: Column) -> Column:
    """In a folder whose name starts with a dot."""
    return path.rlike(r"(^|/)\.[^/]+/")


def set_aside(path: Column, places: Iterable[str] = ()) -> Column:
    """In a folder of deleted files, thumbnails or snapshots: by its name, or one of the places given (a home's own trash and thumbnails, whose names are ordinary)."""
    folders = F.slice(F.split(F.lower(path), "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    named = F.exists(folders, lambda f: f.isin(*SET_ASIDE) | f.startswith(SET_ASIDE_BEGIN))
    return named | excluded(path, places)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def accepts(path: Column, wanted: Iterable[str] | None = None, but: Iterable[str] = ()) -> Column:
    """Files of the wanted extensions; without any, all but those named, files without an extension too."""
    if wanted is None:
        return ~extension(path).isin(*[b.lower().lstrip(".") for b in but]) if but else F.lit(True)
    return extension(path).isin(*[w.lower().lstrip(".") for w in wanted])


def names_an_image(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def sniff(content: Column) -> Column:
    """Format told by the first bytes, null if none or if there are fewer than 12: short signatures must also look like their format."""
    data = F.substring(content.cast("binary"), 1, 64)
    head = F.hex(data)
    at = lambda start, n: F.substring(head, 1 + 2 * start, 2 * n)
    little = lambda start: F.conv(F.concat(at(start + 1, 1), at(start, 1)), 16, 10).cast("int")
    # the first brand, and those after the version as far as the box goes
    size = F.conv(at(0, 4), 16, 10).cast("bigint")
    listed = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when(size >= 20 + 4 * i, F.substring(head, 33 + 8 * i, 8)))
    brands = F.array_union(F.array(at(8, 4)), listed)
    looks = {
        "bmp": at(14, 4).isin("", "0C000000", "28000000", "34000000", "38000000", "40000000", "6C000000", "7C000000") | (F.length(at(14, 4)) < 8),
        # an entry at least, of no more than 256 planes and bits
        "ico": (little(4) > 0) & F.coalesce(little(10) <= 256, F.lit(True)) & F.coalesce(little(12) <= 256, F.lit(True)),
    }
    # after blanks and comments a digit, or for the last kind a line that begins with one of its fields
    text = F.decode(data, "ISO-8859-1")
    number = text.rlike(r"^P[1-6](?:[\t-\r ]|#[^\n\r]*(?:[\n\r]|\z))*(?:[0-9]|\z)")
    fields = text.rlike(r"^P7(?:\z|\n(?:#[^\n]*\n)*(?:#[^\n]*\z|[\t-\r ]*(?:ENDHDR|HEIGHT|WIDTH|DEPTH|MAXVAL|TUPLTYPE)(?:[\t-\r ]|\z)))")
    said = F.when(number | fields, "pnm")
    said = F.when((at(4, 4) == "66747970") & F.arrays_overlap(brands, F.array(*[F.lit(b.encode().hex().upper()) for b in HEIF_BRANDS])), "heif").otherwise(said)
    said = F.when((at(0, 4) == "52494646") & (at(8, 4) == "57454250"), "webp").otherwise(said)
    for name, start, magic in reversed(SIGNATURES):
        said = F.when((at(start, len(magic) // 2) == magic) & looks.get(name, F.lit(True)), name).otherwise(said)
    return F.when(F.octet_length(data) >= 12, said)


def format_of(path: Column, content: Column) -> Column:
    """By the head, or by the extension for the one format without a signature."""
    return F.coalesce(sniff(content), F.when(extension(path) == "tga", "tga"))


def problems(files: DataFrame) -> DataFrame:
    """(category, weight, path) of files that can't be asked: empty, not an image by its head, of a name that is no image's."""
    kind = F.when(F.col("length") == 0, "empty").when(F.col("format").isNull() & names_an_image(F.col("path")), "not an image").when(F.col("format").isNull(), "other file")
    found = files.withColumn("category", kind).filter("category is not null")
    return found.select("category", F.when(F.col("category") == "other file", "skip").otherwise("problem").alias("weight"), "path")


def tally_problems(found: DataFrame, samples: int = 10) -> DataFrame:
    """Counts of each category and its first paths; only so many paths of each are gathered."""
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy("path"))).filter(F.col("_n") <= samples)
    shown = first.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "path"))), lambda s: s["path"]), "|").alias("samples"))
    return found.groupBy("category", "weight").agg(F.count(F.lit(1)).alias("n")).join(shown, "category")
