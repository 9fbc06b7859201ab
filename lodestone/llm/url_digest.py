"""URL filter over a sorted digest array.

Every listed string (a blocked host, or ``host + path prefix`` of a rule) is kept as its 64-bit
xxhash in one sorted array, with the full strings, the length of their hosts and their verdicts beside
it. The arrays are written once, handed to the executors as files and memory-mapped there, so that
workers of a machine share their pages and hold nothing else of the list. Blocked hosts come from a
table; its size is looked up first, and a list of more than ``MOST_BYTES`` is joined instead.
A url is turned into the strings that could be listed (each suffix of its host, alone and with the
path prefixes of the lengths that occur in the rules); their digests are looked up by one
vectorised binary search a batch, and a hit counts only if the stored string is the same.

Null urls and urls without ``://`` have an empty host and path and fit nothing: verdict ``allow``.
Long urls are judged whole. Of rules that fit, the longest string wins, of equally long ones the one
with the longer host. A null page_id is passed on, repeated rows are judged row by row, an empty table
gives an empty one; null hosts of the list are passed over, repeated ones count once. Other columns of
the input are not looked at.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

#: The rules, as (host, path prefix, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Sites of the default blocklist; each is blocked with all its subdomains.
BLOCKED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in BLOCKED_NAMES for top in ("com", "net", "org"))
#: The most that the array and its strings may take, since every executor gets a copy.
MOST_BYTES = 4 << 30
SEED = 0


#: Kinds of listed strings, as they are kept beside them.
HOST, RULE_ALLOW, RULE_BLOCK = 0, 1, 2


def digests(texts: list[str]) -> np.ndarray:
    """64-bit xxhash of each string's UTF-8 bytes."""
    return np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), SEED) for t in texts), np.uint64, len(texts))


class DigestArray:
    """A read-only list of strings on disk: digests in order, then where each string is, what is known of it, and the strings."""

    PARTS = ("keys", "bounds", "facts", "strings")

    def __init__(self, folder: str | Path, stem: str):
        self.keys = np.memmap(f"{folder}/{stem}.keys", np.uint64, "r")
        self.bounds = np.memmap(f"{folder}/{stem}.bounds", np.int64, "r")
        self.facts = np.memmap(f"{folder}/{stem}.facts", np.int32, "r").reshape(-1, 2)
        self.strings = np.memmap(f"{folder}/{stem}.strings", np.uint8, "r")

    @staticmethod
    def write(folder: Path, stem: str, texts: list[str], facts: np.ndarray) -> None:
        """Writes the files of these strings and of two numbers for each (its kind, and characters of its host); a list is never empty on disk."""
        if not texts:
            texts, facts = ["\0"], np.array([[HOST, 1]])
        keys = digests(texts)
        order = np.argsort(keys, kind="stable")
        raw = [texts[i].encode("utf-8", "surrogatepass") for i in order]
        (folder / f"{stem}.keys").write_bytes(keys[order].tobytes())
        (folder / f"{stem}.bounds").write_bytes(np.cumsum([0, *map(len, raw)]).astype(np.int64).tobytes())
        (folder / f"{stem}.facts").write_bytes(np.asarray(facts, np.int32)[order].tobytes())
        (folder / f"{stem}.strings").write_bytes(b"".join(raw))

    def string(self, at: int) -> str:
        """The string at a place."""
        return self.strings[self.bounds[at] : self.bounds[at + 1]].tobytes().decode("utf-8", "surrogatepass")

    def find(self, texts: list[str], of_host: np.ndarray) -> np.ndarray:
        """Place of each string in the array, or -1: as a host where ``of_host``, else as a rule.

        Equal digests are told apart by the strings.
        """
        wanted = digests(texts)
        low, high = np.searchsorted(self.keys, wanted, "left"), np.searchsorted(self.keys, wanted, "right")
        found = np.full(len(texts), -1, np.int64)
        for i in np.flatnonzero(low < high):
            own = texts[i].encode("utf-8", "surrogatepass")
            for at in range(low[i], high[i]):
                if (self.facts[at, 0] == HOST) == of_host[i] and self.strings[self.bounds[at] : self.bounds[at + 1]].tobytes() == own:
                    found[i] = at
                    break
        return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    _, scheme, rest = (url or "").partition("://")
    if not scheme:
        return "", ""
    host_end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[host_end:]
    path_end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return _ascii_lower(rest[:host_end]), tail[:path_end]


def _ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def host_suffixes(host: str) -> list[str]:
    """The host and each of its parent domains."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


def _handed_out(spark: SparkSession, rules: list[tuple[str, str, str]], hosts: list[str]) -> str:
    """Writes the list, hands its files to all executors, and returns their stem."""
    listed = {(h + p, True): (RULE_BLOCK if v == "block" else RULE_ALLOW, len(h)) for h, p, v in reversed(rules)}
    listed |= {(h, False): (HOST, len(h)) for h in hosts}
    texts, facts = [text for text, _ in listed], np.array(list(listed.values()), np.int32).reshape(-1, 2)
    folder = Path(tempfile.mkdtemp(prefix="lodestone-urls-")).resolve()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the files from there while it runs
    DigestArray.write(folder, "urls", texts, facts)
    mark = hashlib.sha256(b"".join((folder / f"urls.{part}").read_bytes() for part in DigestArray.PARTS)).hexdigest()[:24]
    stem = f"urls-{mark}"
    known = {Path(f).name for f in spark.sparkContext.listFiles}
    for part in DigestArray.PARTS:
        if f"{stem}.{part}" not in known:
            (folder / f"urls.{part}").rename(folder / f"{stem}.{part}")
            spark.sparkContext.addFile(str(folder / f"{stem}.{part}"))
    return stem


def url_filter(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, hosts: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per page: page_id, host, path, the rule that fits (the longest) and the verdict.

    Without a fitting rule a page is blocked if its host or a parent domain is listed (``hosts``: a
    table with a column host; ``BLOCKED_HOSTS`` if it is not given).
    """
    spark, rules = pages.sparkSession, list(rules)
    if hosts is None:
        hosts = spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "host string")
    listed = common.only(hosts, "host").where("host IS NOT NULL").distinct()
    size = listed.agg(F.sum(F.octet_length("host") + 24)).first()[0] or 0
    small = size <= most_bytes
    stem = _handed_out(spark, rules, [r["host"] for r in listed.toLocalIterator()] if small else [])
    prefix_lengths = sorted({len(path) for _, path, _ in rules})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.getRootDirectory(), stem)
        for batch in batches:
            ids, split = batch.column("page_id"), [split_url(u) for u in batch.column("url").to_pylist()]
            probes: list[str] = []
            owners: list[int] = []
            of_host: list[bool] = []
            for row, (host, path) in enumerate(split):
                for suffix in host_suffixes(host):
                    own = [suffix, *(suffix + path[:n] for n in prefix_lengths if n <= len(path))]
                    probes += own
                    of_host += [True, *[False] * (len(own) - 1)]
                    owners += [row] * len(own)
            found = array.find(probes, np.array(of_host, bool))
            best: dict[int, tuple[int, int, int]] = {}
            blocked: set[int] = set()
            for i in np.flatnonzero(found >= 0):
                at, row = int(found[i]), owners[i]
                if of_host[i]:
                    blocked.add(row)
                else:
                    best[row] = max(best.get(row, (0, 0, 0)), (len(probes[i]), int(array.facts[at, 1]), at))
            fitting = [best[row][2] if row in best else None for row in range(len(split))]
            verdicts = [("block" if array.facts[at, 0] == RULE_BLOCK else "allow") if at is not None else "block" if row in blocked else "allow" for row, at in enumerate(fitting)]
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array([None if at is None else array.string(at) for at in fitting], pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    judged = common.only(pages, "page_id", "url").mapInArrow(rows, "page_id long, host string, path string, rule string, verdict string")
    return judged if small else _blocked_by_join(judged, listed)


def _blocked_by_join(judged: DataFrame, listed: DataFrame) -> DataFrame:
    """Pages without a rule, blocked where their host or a parent domain is in a table of any size."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    own = judged.where("rule IS NULL").select("host").distinct()
    bad = own.select("host", F.explode(suffixes).alias("_suffix")).join(listed.select(F.col("host").alias("_suffix")), "_suffix", "left_semi").select("host", F.lit(True).alias("_bad")).distinct()
    verdict = F.when(F.col("rule").isNull() & F.col("_bad"), "block").otherwise(F.col("verdict"))
    return judged.join(bad, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def oracle() -> str:
    """The same by DuckDB: each rule and listed site as a test of host and path."""
    fits = lambda host: f"(host = '{host}' OR host LIKE '%.{host}')"
    longest_first = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    rule = " ".join(f"WHEN {fits(h)} AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in longest_first)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in RULES)
    sites = " OR ".join(fits(h) for h in BLOCKED_HOSTS)
    return f"""
        WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        lowered AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
        ruled AS (SELECT *, CASE {rule} ELSE NULL END AS rule FROM lowered)
        SELECT page_id, host, path, rule, CASE {verdict} WHEN {sites} THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""
