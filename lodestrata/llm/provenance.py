"""Problem 3: files nobody wrote by hand, by belief propagation over directory trees.

Each file is a node with evidence for the labels handwritten, generated, minified, vendored and blob, read from its
whole content; each directory is a node whose state pulls its files and sub-directories towards one label. The factor
graph of a project is a tree, so one upward and one downward pass of sum-product messages give the exact marginals:
parents and siblings inform a file through their directory, and what a node hears never holds what it said itself.

Both passes go level by level. A directory's incoming messages are a sum over its children, which Spark aggregates on
the map side, so a directory of any size costs one row per task and no group is collected. The states of a level are
checkpointed; there are as many levels as the deepest path of the data has folders.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.paths import normal_path
from lodestrata.session import ensure_checkpoint_dir, spread

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
MAX_LIBRARY_BYTES = 64 << 20
SHINGLE = 5
FILE_PULL, FOLDER_PULL = 0.7, 0.6  # how much of a child's label is its directory's; a folder's message weighs up to log(0.7 / 0.075) = 2.2
PRIOR = -4.0  # log odds of each label against handwritten; with one weak clue more, the folder decides
LEAST_SHARED = 4  # shingles; fewer are a phrase, not a copy

HEADER = re.compile(
    r"(?i)\bcode generated\b.{0,80}\b(?:do not|don't)\b|@generated\b|<auto-?generated|\bauto-?generated\b|\bgenerated (?:file|code|by|from|automatically|with)\b(?! hand)|\b(?:this|the) (?:file|code|module|class)\b.{0,30}\b(?:is|was|has been)\b.{0,20}\b(?:generated|produced|created|written|emitted)\b.{0,12}\b(?:by|from|automatically|with)\b|\bautomatically (?:produced|generated|created|written|emitted)\b|\bmachine[- ](?:made|generated|written)\b|\bdo not (?:modify|edit|change|touch)\b.{0,6}\b(?:written|generated|created|produced|emitted|output)\b.{0,12}\bby\b|\b(?:changes|edits|modifications)\b.{0,40}\b(?:overwritten|be lost|discarded)\b|\bregenerate instead\b|\boutput of \S+ (?:gen|build|compile)"
    r"|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bnicht von hand (?:bearbeiten|ändern)\b|\botomatik (?:olarak )?(?:oluştur|üret)|\bgenerad[oa] autom[aá]ticamente\b|\bg[eé]n[eé]r[eé] automatiquement\b"
)
NOT_HEADER = re.compile(r"(?i)\bhand[- ]?written\b|\bnot (?:auto-?)?generated\b|\bby hand\b(?!.{0,12}bearbeiten)|\bgenerates\b|\bgenerator (?:for|could|of|that)\b|\bhelper for\b|\bwrites the\b")
BANNER = re.compile(r"(?i)(?:/\*!?|//|#|\*)\s*(?!(?:version|licen[cs]e)\b)(?P<name>[\w.-]+)\s+v?\d+\.\d+(?:\.\d+)*\b")
CONTRIBUTORS = re.compile(r"(?i)\(c\)[^\n]{0,60}\bcontributors\b|@license\b|@preserve\b|\blicensed under the\b|\bspdx-license-identifier\b")
VENDOR_DIR = re.compile(r"(?:^|/)(?:vendor|vendored|node_modules|bower_components|third[_-]party(?:_\w+)?|3rdparty|godeps|extern|external|deps)/", re.I)
BUILD_DIR = re.compile(r"(?:^|/)(?:dist|build|public|static|assets|out|web/lib|min)/", re.I)
GENERATED_PATH = re.compile(r"(?:^|/)(?:gen|generated|__generated__|pb|stubs?)/|\.(?:g|gen|pb|generated|designer)\.\w+$|_pb2?\.\w+$|_pb2_grpc|Stub\.\w+$|_client\.\w+$|\.pb\.", re.I)
LOCK_NAME = re.compile(r"(?:^|/)(?:package-lock|composer[.-]lock|deps\.lock|pipfile\.lock|poetry\.lock|yarn\.lock|cargo\.lock|gemfile\.lock|go\.sum|pnpm-lock|npm-shrinkwrap)\w*", re.I)
LITERAL = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|\b0[xX][0-9a-fA-F]+\b|[-+]?\b\d+(?:\.\d+)?(?:[eE][-+]?\d+)?\b")
COMMENT = re.compile(r"/\*.*?\*/|(?<![:\"'\w])//[^\n]*|(?m:^\s*#(?!\!)[^\n]*)", re.S)
MEMBER = re.compile(r"(?m)^\s*(?:public )?(?:function |String |void |def |\w+ )?(?:get|set|has|clear)[A-Z_]\w*\s*\(|wire:\"|descriptor|_serialized|\bfunction \(m\)|^\s*\w+\d+\??: [\w<>\[\], ]+;|^\s*F\d+ |^\s*\w*\d+: '/|\) (?:Get|Set)[A-Z]\w*\(")
COMMENT_LINE = re.compile(r"\s*(?://|#|/?\*|<!--|;|--|\"\"\"|<\?php)")
BLOCKS = {"/*": "*/", "<!--": "-->", '"""': '"""'}
PREAMBLE = re.compile(r"\s*(?:<\?php\b|<\?xml\b|#!|(?:package|namespace) [\w.\\\\]+;?\s*$|['\"]use strict['\"];?\s*$|declare\(strict_types)")
DESCRIPTOR = re.compile(r"descriptor_pool|(?<!\w)_descriptor\b|AddSerializedFile|protoc?_gen")
TYPE = re.compile(r"(?m)^[ \t]*(?:(?:public|final|abstract|export|default|static) )*(?:class|interface|type|struct|enum) (\w+)")
WORD_BYTES = bytes(c for c in range(128) if chr(c).isalnum() or chr(c) in "_ \t\r")
CODE = frozenset("py js jsx ts tsx go java php rb rs c h cpp cs kt swift scala vue".split())


def shingles(text: str) -> set[int]:
    """Hashes of five words in a row, case and marks ignored."""
    w = re.findall(r"\w+", text.lower())
    return {hash_words(w[i : i + SHINGLE]) for i in range(max(0, len(w) - SHINGLE + 1))}


def hash_words(w: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(w).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


class Library:
    """Known third-party files: an inverted index of their shingles, which makes the comparison exact."""

    def __init__(self, files: list[str]):
        self.index: dict[int, list[int]] = {}
        self.sizes: list[int] = []
        for k, text in enumerate(files):
            own = shingles(text)
            self.sizes.append(len(own))
            for x in own:
                self.index.setdefault(x, []).append(k)

    def overlap(self, text: str) -> float:
        """The largest share of the smaller one's shingles that the text has in common with a known file."""
        own = shingles(text)
        common: dict[int, int] = {}
        for x in own:
            for k in self.index.get(x, ()):
                common[k] = common.get(k, 0) + 1
        return max((n / max(1, min(len(own), self.sizes[k])) for k, n in common.items() if n >= LEAST_SHARED), default=0.0)


def comment_lines(text: str) -> tuple[list[str], list[str]]:
    """(all lines of comments, those that stand before the first line of code), however long; code after a comment is cut off."""
    found, leading, close = [], None, ""
    for line in text.split("\n"):
        bare = line.strip()
        if close:
            at = bare.find(close)
            found.append(bare if at < 0 else bare[:at])
            close = close if at < 0 else ""
        elif mark := next((x for x in BLOCKS if bare.startswith(x)), ""):
            if mark == '"""' and leading is not None:  # a text in the code; its first line is read as before
                found.append(bare)
                continue
            at = bare.find(BLOCKS[mark], len(mark))
            found.append(bare if at < 0 else bare[:at])
            close = BLOCKS[mark] if at < 0 else ""
            if at >= 0 and leading is None and len(bare) > at + len(BLOCKS[mark]):
                leading = list(found)
        elif COMMENT_LINE.match(line):
            found.append(bare)
        elif bare and leading is None and not PREAMBLE.match(line):
            leading = list(found)
    return found, found if leading is None else leading


def evidence(path: str, text: str, library: Library) -> tuple[float, ...]:
    """Log-likelihoods of the labels given the file alone."""
    path = path or ""
    base = path.rpartition("/")[2]
    ending = base.rpartition(".")[2].lower() if "." in base else ""
    generated = minified = vendored = blob = PRIOR
    size = len(text)
    comments, leading = comment_lines(text)

    if any(HEADER.search(line) and not NOT_HEADER.search(line) for line in comments):
        generated += 12
    if GENERATED_PATH.search(path):
        generated += 1.5
    if LOCK_NAME.search(path) or base.lower().endswith(".lock"):
        generated += 4
    if ending in ("json", "lock", "yaml", "yml", "toml", "sum"):
        locks = len(re.findall(r"\"(?:integrity|resolved|lockfileVersion|content-hash|dist|shasum)\"|^\s*(?:integrity|resolved|checksum|resolution):? |h1:[\w+/=]{20}", text, re.M))
        if locks >= 3 and locks * 12 >= text.count("\n") * 0.6 or "\"lockfileVersion\"" in text or "\"content-hash\"" in text:
            generated += 9

    lines = text.count("\n") + 1
    if ending in CODE or ending in ("css", "html", "scss"):
        if size and ending in ("js", "css", "ts", "jsx", "mjs", "html", "php"):
            blank = text.count(" ") + text.count("\n") + text.count("\t")
            mean = size / lines
            dense = blank / size
            longest = max(map(len, text.split("\n")))
            if mean > 250 and dense < 0.09 or mean > 120 and dense < 0.07 and longest > 400:
                bare = LITERAL.sub("", text) if longest > 400 else text
                if len(bare) > 0.5 * size and len(re.findall(r"[;{}]", bare)) * 60 > len(bare):
                    minified += 12
            if re.search(r"[.-]min\.\w+$", base):
                minified += 3
        if BUILD_DIR.search("/" + path):
            minified += 1

    if ending in CODE and size:
        # the marks that are left of a line without its words are its shape
        rows = [x for x in text.encode("utf-8", "replace").translate(None, WORD_BYTES).split(b"\n") if len(x) > 1]
        kinds = len(set(rows))
        longest = max(map(len, text.split("\n")))
        plain = len({x.translate(None, b"-+.") for x in rows})
        if (plain <= max(10, 0.1 * len(rows)) or longest * 2 > size):
            code = COMMENT.sub(" ", text)
            rest = LITERAL.sub("\0", code)
            names = len(re.findall(r"[A-Za-z_$][\w$]*", rest))
            literals = rest.count("\0")
            share = 1 - len(re.sub(r"[\0\s,\[\](){};:.+=>&|-]", "", rest)) / max(1, len(code.strip()))
            if names <= 14 + literals / 40 and share > 0.9 and (literals >= 24 or len(code) / max(1, literals) > 200):
                blob += 12
        if len(rows) >= 8 and kinds <= 0.3 * len(rows):
            members = len(MEMBER.findall(text))
            if members * 3 >= len(rows):
                generated += 10
        first = TYPE.search(text)
        if DESCRIPTOR.search(text) or first and first[1].endswith("Msg"):
            generated += 6

    if VENDOR_DIR.search("/" + path):
        vendored += 2
    banner = "\n".join(comments)
    if CONTRIBUTORS.search(banner) and BANNER.search(banner):
        vendored += 8
    elif CONTRIBUTORS.search(banner):
        vendored += 2
    share = library.overlap(text)
    if share >= 0.3:
        vendored += 20 * share
    return (0.0, generated, minified, vendored, blob)


def compatibility(pull: float) -> list[list[float]]:
    """How well a child's label goes with its directory's: `pull` if they are the same, the rest in equal parts."""
    other = (1 - pull) / (len(LABELS) - 1)
    return [[pull if i == k else other for k in range(len(LABELS))] for i in range(len(LABELS))]


STATES = range(len(LABELS))


def send(rows: DataFrame, score: str, message: str, pull: float) -> DataFrame:
    """`rows` with the log message of states `score`0.. through the compatibilities as `message`0.., the largest zero."""
    links = compatibility(pull)
    top = F.greatest(*(F.col(f"{score}{k}") for k in STATES))
    rows = rows.withColumns({f"__x{k}": F.exp(F.col(f"{score}{k}") - top) for k in STATES})
    sums = [F.log(sum((F.col(f"__x{j}") * links[j][k] for j in STATES), F.lit(0.0))) for k in STATES]
    rows = rows.withColumns({f"__y{k}": x for k, x in enumerate(sums)})
    top = F.greatest(*(F.col(f"__y{k}") for k in STATES))
    rows = rows.withColumns({f"{message}{k}": F.col(f"__y{k}") - top for k in STATES})
    return rows.drop(*(f"__{x}{k}" for x in "xy" for k in STATES))


def prefix(path: Column, n: Column) -> Column:
    """The first n segments of a path."""
    return F.array_join(F.slice(F.split(path, "/"), F.lit(1), n), "/")


def propagate(nodes: DataFrame, file_pull: float = FILE_PULL, folder_pull: float = FOLDER_PULL) -> DataFrame:
    """`nodes` (project_id, file_path and the log evidence e0..e4 of each file) with label and its belief DOUBLE.

    project_id isn't null, paths are in their normal notation. Sum-product: messages of files into their folder, of
    folders into their parents, deepest level first; then of parents into folders, each without what that folder sent;
    a file's belief is its evidence and the message of its folder without its own.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    depth = F.size(F.split("file_path", "/")) - 1
    nodes = send(nodes, "e", "u", file_pull).withColumn("folder", prefix(F.col("file_path"), depth))
    own = nodes.groupBy("project_id", "folder").agg(*(F.sum(f"u{k}").alias(f"s{k}") for k in STATES))
    deep = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    every = own.withColumn("deep", deep).withColumn("depth", F.explode(F.sequence(F.lit(0), "deep")))
    every = every.select("project_id", prefix(F.col("folder"), F.col("depth")).alias("folder"), "depth", *(F.when(F.col("depth") == F.col("deep"), F.col(f"s{k}")).otherwise(0.0).alias(f"s{k}") for k in STATES))
    tree = every.groupBy("project_id", "depth", "folder").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in STATES)).checkpoint()
    deepest = tree.agg(F.max("depth")).first()[0]
    if deepest is None:
        return nodes.select("*", F.lit(LABELS[0]).alias("label"), F.lit(1.0).alias("belief")).drop("folder", *(f"u{k}" for k in STATES))

    key, sums = ["project_id", "folder"], [f"s{k}" for k in STATES]
    level: dict[int, DataFrame] = {}
    for d in range(deepest, -1, -1):
        here = tree.where(F.col("depth") == d).select(*key, *sums)
        if d < deepest:
            below = level[d + 1].select("project_id", F.col("parent").alias("folder"), *(F.col(f"m{k}").alias(f"s{k}") for k in STATES))
            here = here.unionByName(below).groupBy(*key).agg(*(F.sum(x).alias(x) for x in sums))
        level[d] = send(here, "s", "m", folder_pull).withColumn("parent", prefix(F.col("folder"), F.lit(d - 1)) if d > 1 else F.lit("")).checkpoint()

    heard = level[0].select(*key, *(F.col(f"s{k}").alias(f"h{k}") for k in STATES))
    folders = heard
    for d in range(1, deepest + 1):
        above = heard.select(F.col("project_id").alias("__p"), F.col("folder").alias("__f"), *(F.col(f"h{k}").alias(f"c{k}") for k in STATES))
        both = level[d].join(above, (F.col("project_id") == F.col("__p")) & (F.col("parent") == F.col("__f")))
        both = send(both.withColumns({f"c{k}": F.col(f"c{k}") - F.col(f"m{k}") for k in STATES}), "c", "d", folder_pull)
        heard = both.select(*key, *((F.col(f"s{k}") + F.col(f"d{k}")).alias(f"h{k}") for k in STATES)).checkpoint()
        folders = folders.unionByName(heard)

    # a file hears its folder without its own message
    files = nodes.join(folders, key)
    files = send(files.withColumns({f"h{k}": F.col(f"h{k}") - F.col(f"u{k}") for k in STATES}), "h", "d", file_pull)
    belief = F.array(*(F.col(f"e{k}") + F.col(f"d{k}") for k in STATES))
    files = files.withColumn("__b", belief).withColumn("__top", F.array_max("__b"))
    label = F.element_at(F.array(*map(F.lit, LABELS)), F.array_position("__b", F.col("__top")).cast("int"))
    files = files.withColumns({"label": label, "belief": 1 / F.aggregate("__b", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__top")))})
    return files.drop("folder", "__b", "__top", *(f"{x}{k}" for x in "uhd" for k in STATES))


def file_evidence(points: DataFrame, library_files: DataFrame) -> DataFrame:
    """point_id, project_id, file_path, e0..e4 DOUBLE: log evidence of each judged file, once; a null project is \\0."""
    known = library_files.where(F.col("content").isNotNull())
    weight = known.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    if weight > MAX_LIBRARY_BYTES:
        raise ValueError(f"library_files has {weight} bytes; split it into lists of at most {MAX_LIBRARY_BYTES}")
    library = Library([r.content for r in known.select("content").collect()])

    files = points.where((F.col("symbol_type") == "file") & F.col("content").isNotNull())
    files = files.select("point_id", F.coalesce("project_id", F.lit("\0")).alias("project_id"), normal_path(F.coalesce("file_path", F.lit(""))).alias("file_path"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [evidence(p, t, library) for p, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            own = np.array(scores, float).reshape(-1, len(LABELS))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c) for c in own.T)], names=["point_id", "project_id", "file_path", *(f"e{k}" for k in STATES)])

    ddl = "point_id string, project_id string, file_path string, " + ", ".join(f"e{k} double" for k in STATES)
    ensure_checkpoint_dir(points.sparkSession)
    return spread(files).mapInArrow(read, ddl).checkpoint().dropDuplicates(["point_id"])


def judge_files(points: DataFrame, library_files: DataFrame, file_pull: float = FILE_PULL, folder_pull: float = FOLDER_PULL) -> DataFrame:
    """point_id, project_id, file_path, label, belief DOUBLE of each point of symbol_type `file` with a content.

    Paths are brought to their normal notation; a null project is a tree of its own, a null path lies in the root.
    Rows that repeat a point_id are one point. Null contents have no row; an empty text is handwritten. `library_files`
    is a fixed list and is sent to all tasks; above MAX_LIBRARY_BYTES an error is raised. Other columns are ignored.
    """
    judged = propagate(file_evidence(points, library_files), file_pull, folder_pull)
    return judged.select("point_id", F.when(F.col("project_id") != "\0", F.col("project_id")).alias("project_id"), "file_path", "label", "belief")
