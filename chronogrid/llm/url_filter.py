"""URL filters: rules for hosts with path prefixes, in a sorted digest array.

A rule is a host, a path prefix and a verdict; it fits its host and all
subdomains of it if the url's path starts with the prefix.  The rule with the
longest text (host and path together) wins.

The rules lie in one file: 64-bit xxhash digests of the rule texts in sorted
order, the texts themselves, and the verdicts.  Executors get the file from
Spark, map it into memory, and probe it by a binary search over whole batches;
a digest that is found counts only if the stored text is equal.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import need_columns

#: Host, path prefix, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Of a url that no rule fits.
DEFAULT = "allow"
#: The largest rule file that is sent to executors.
MOST_BYTES = 4 << 30
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def write_rules(rules: Iterable[tuple[str, str, str]], path: str) -> None:
    """Write the digest array of ``rules``; the last of equal rules counts."""
    chosen = {host + where: verdict for host, where, verdict in rules}
    lengths = sorted({len(r) - len(r.partition("/")[0]) for r in chosen})
    rows = sorted((xxhash.xxh64_intdigest(r), r.encode(), v == "block") for r, v in chosen.items())
    ends = np.cumsum([len(r[1]) for r in rows], dtype=np.int64)
    with open(path, "wb") as f:
        f.write(np.array([len(rows), len(lengths)], "<i8").tobytes())
        f.write(np.array(lengths, "<i8").tobytes())
        f.write(np.array([r[0] for r in rows], "<u8").tobytes())
        f.write(ends.astype("<i8").tobytes())
        f.write(np.array([r[2] for r in rows], "u1").tobytes())
        f.write(b"".join(r[1] for r in rows))


class RuleArray:
    """A rule file, mapped into memory."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n, m = data[:16].view("<i8").tolist()
        at = 16
        self.path_lengths = data[at : at + 8 * m].view("<i8").tolist()
        at += 8 * m
        self.digests = data[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.ends = data[at : at + 8 * n].view("<i8")
        at += 8 * n
        self.blocks = data[at : at + n]
        self.texts = data[at + n :]

    def find(self, texts: list[str]) -> np.ndarray:
        """The place of each text in the array, or -1."""
        out = np.full(len(texts), -1, np.int64)
        if not len(self.digests) or not texts:
            return out
        keys = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
        at = np.searchsorted(self.digests, keys)
        while True:  # once, and again where digests collide
            hit = np.flatnonzero((out < 0) & (at < len(self.digests)))
            hit = hit[self.digests[at[hit]] == keys[hit]]
            if not len(hit):
                return out
            for i in hit.tolist():
                k = int(at[i])
                if self.text(k) == texts[i]:
                    out[i] = k
            at[hit] += 1

    def text(self, k: int) -> str:
        start = self.ends[k - 1] if k else 0
        return self.texts[start : self.ends[k]].tobytes().decode()

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """The winning rule and its verdict for each url."""
        texts, owner = [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            at = 0
            while True:
                tail = host[at:]
                for n in self.path_lengths:
                    if n <= len(path):
                        texts.append(tail + path[:n])
                        owner.append(i)
                at = host.find(".", at) + 1
                if not at:
                    break
        best: list[tuple[str | None, str | None]] = [(None, None)] * len(hosts)
        for t, i, k in zip(texts, owner, self.find(texts).tolist()):
            if k >= 0 and len(t) > len(best[i][0] or ""):
                best[i] = t, "block" if self.blocks[k] else "allow"
        return best


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``.

    The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, with
    A-Z lower-cased, and the path from there to ``?``, ``#`` or the end.  A null
    url, or one without ``://``, has an empty host and path; no rule fits an
    empty host, as rules have hosts.  Repeated rows are judged alike.
    """
    need_columns(pages, "page_id", "url")
    spark = pages.sparkSession
    # Spark serves the file to executors from here until the driver ends
    folder = tempfile.mkdtemp(prefix="rules-")
    atexit.register(shutil.rmtree, folder, True)
    local = os.path.join(folder, f"rules-{os.urandom(8).hex()}.bin")
    write_rules(rules, local)
    if os.path.getsize(local) > MOST_BYTES:
        raise ValueError("too many rules to send to every executor")
    spark.sparkContext.addFile(local)
    name = os.path.basename(local)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = RuleArray(SparkFiles.get(name))
        for b in batches:
            got = array.judge(b.column(1).to_pylist(), b.column(2).to_pylist())
            rule = pa.array([r for r, _ in got], pa.string())
            verdict = pa.array([v or default for _, v in got], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    part = lambda i: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    urls = pages.select("page_id", F.translate(part(1), _UPPER, _LOWER).alias("host"), part(2).alias("path"))
    kind = dict(pages.dtypes)["page_id"]
    return urls.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's url."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE_SQL = f"""
WITH rules(h, p, v) AS (VALUES {_VALUES}), urls AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), fits AS (
  SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM urls LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM fits
"""
