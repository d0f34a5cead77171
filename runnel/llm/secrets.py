"""Secret scan with corpus-wide ownership frequency.

A scan proposes spans; every value is hashed, and the hashes are counted over
the whole corpus by distinct repository and owner.  A value that many owners
hold is a widely copied example.  One that belongs to a single owner, or a few,
looks live if it stays in few repositories; if it is all over its owner's
repositories it is spread, a template or a shared credential.  Only hashes
travel, never the values.

Null and empty texts have no spans.  A null repository or owner counts as one
of that name.  Rows are scanned one by one, so repeated rows and ids give
repeated results.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, few, map_rows, settle, span_digest

KINDS = ["assign", "access", "hex", "key", "service"]
BASE = KINDS[:3]

# The character classes are the contract's; a look-behind only saves needless starts.
_ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
# Kinds that the scan adds: private key headers and prefixed service tokens.
_KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")
_SERVICE = re.compile(r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[abpr]-[A-Za-z0-9-]{10,})")


def scan_text(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of every proposed span; offsets are code points."""
    out = []
    for m in _ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 8:
            out.append(("assign", m.start(), m.end(), m.group(1)))
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= 16:
            out.append(("access", m.start(), m.end(), m.group()))
    for kind, pattern in (("hex", _HEX), ("key", _KEY), ("service", _SERVICE)):
        out += [(kind, m.start(), m.end(), m.group()) for m in pattern.finditer(text)]
    return out


def _named(docs: DataFrame, what: str | Column | None) -> Column:
    column = docs[what] if isinstance(what, str) else F.lit(None) if what is None else what
    return F.coalesce(column.cast("string"), F.lit(""))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: str | Column | None = "source", owner: str | Column | None = "source") -> DataFrame:
    """(doc_id, repo, owner, found): ``found`` lists kind, start, stop and the hash of the value."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), _named(docs, repo).alias("repo"), _named(docs, owner).alias("owner"))

    def make():
        def work(rows):
            for doc_id, text, repo, owner in rows:
                found = [{"kind": k, "start": a, "stop": b, "hash": hashlib.sha256(v.encode("utf-8", "replace")).digest()[:16]} for k, a, b, v in scan_text(text)]
                yield doc_id, repo, owner, found

        return work

    return map_rows(rows, make, "doc_id long, repo string, owner string, found array<struct<kind:string,start:long,stop:long,hash:binary>>")


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, n_seen, n_repos, n_owners) over the corpus.

    Counted in two steps, so a value that fills the corpus is first reduced to
    a row for each repository and owner in every task.
    """
    each = scanned.select("repo", "owner", F.explode("found").alias("f")).select("repo", "owner", F.col("f.hash").alias("hash"))
    pairs = each.groupBy("hash", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    repos = pairs.groupBy("hash", "repo").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.sum("n").alias("n_seen"), F.count(F.lit(1)).alias("n_repos"))
    owners = pairs.groupBy("hash", "owner").agg(F.lit(1)).groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return repos.join(owners, "hash")


def find_secrets(docs: DataFrame, max_owners: int = 2, max_repos: int = 3, **columns: str | Column | None) -> DataFrame:
    """One row for each document: its spans, their digest, and how many look live, spread or copied.

    A value is copied if more than ``max_owners`` owners hold it, spread if
    fewer do in more than ``max_repos`` repositories, else live.  Only values
    of several repositories are joined; what most values are needs no row.
    """
    scanned = cut(scan(docs, **columns).withColumn("row", F.monotonically_increasing_id()))
    spans = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", F.col("f.hash").alias("hash"))
    several = few(settle(ownership(scanned).where("n_repos > 1 OR n_owners > 1").select("hash", "n_repos", "n_owners")))
    owners, repos = F.coalesce("n_owners", F.lit(1)), F.coalesce("n_repos", F.lit(1))
    judged = spans.join(several, "hash", "left").groupBy("row").agg(
        F.count_if((owners <= max_owners) & (repos <= max_repos)).alias("n_live"), F.count_if((owners <= max_owners) & (repos > max_repos)).alias("n_spread"),
        F.count_if(owners > max_owners).alias("n_copied"), F.max(owners).alias("most_owners"), F.max(repos).alias("most_repos"),
    )
    names = ("n_live", "n_spread", "n_copied", "most_owners", "most_repos")
    listed = scanned.join(judged, "row", "left").select("doc_id", "found", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names))

    def make():
        def work(rows):
            for doc_id, found, *counts in rows:
                every = [(f["kind"], f["start"], f["stop"]) for f in found]
                base = [s for s in every if s[0] in BASE]
                n = [sum(s[0] == k for s in base) for k in BASE]
                yield doc_id, *n, span_digest(base, KINDS)[1], span_digest(every, KINDS)[0], *counts

        return work

    return map_rows(listed, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_live long, n_spread long, n_copied long, most_owners long, most_repos long")
