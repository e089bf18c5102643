"""Document fingerprints as Merkle trees over paragraphs and sections.

A text is cut, losing nothing, into paragraphs (up to and with their line ends), and paragraphs into leaves of MIN_LEAF to
MAX_LEAF characters, wherever a rolling hash of the last WINDOW characters picks the place, so that an edit moves no cut
far from it, whatever the script and with or without white space. Paragraphs form sections, which end at a blank line or
at a paragraph that its digest picks; sections hang from the root. A leaf's digest is that of its text; a paragraph's,
a section's and the root's is that of its children's whole digests, 128 bits each. Nothing hashes the text as a whole:
equal roots mean equal trees, and so equal texts.

The fingerprint is the tree as a string, `root:section;section...`, with each section as `digest=paragraph|paragraph...`,
each paragraph as `digest-leaf,leaf...` (of one leaf: that leaf), and each leaf as eight hex digits of its digest and its
length in base 36. compare() descends from unequal roots into unequal sections, and there into unequal paragraphs; the
leaves that are left say where the texts differ (differences()) and how much (likeness()): twice the length of what is
shared, over the sum of the lengths, 1 for equal roots.

Nulls: a null text is an empty one, with a root alone. Documents follow one another by descending doc_id (an integer), nulls
last; rows of equal id by a hash of their text, then by the text; repeated rows follow one another and are equal. An empty
table gives no rows; a single document is its own next; extra columns aren't looked at.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

WINDOW, MIN_LEAF, MEAN_CUT, MAX_LEAF, SECTION_CUT = 12, 16, 48, 192, 16
#: Characters whose rolling hash is made at a time.
HASH_STEP = 1 << 16
_LINE = re.compile(r"[^\n]*\n+|[^\n]+")
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def _base36(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 36)
        out = DIGITS[r] + out
    return out or "0"


def cut_places(text: str) -> list[int]:
    """Places, in order, behind which the rolling hash of the WINDOW characters before picks a cut."""
    out = []
    for at in range(0, len(text), HASH_STEP):
        low = max(0, at - WINDOW)
        x = np.frombuffer(text[low : at + HASH_STEP].encode("utf-32-le", "surrogatepass"), dtype="<u4") * np.uint32(0x9E3779B1)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        h, times = x.copy(), 1
        for k in range(1, min(WINDOW, len(x))):
            times = times * 0xC2B2AE35 % (1 << 32)
            h[k:] += x[:-k] * np.uint32(times)
        picked = np.flatnonzero((h >> np.uint32(12)) % np.uint32(MEAN_CUT) == 0) + low + 1
        out += picked[picked > at].tolist()
    return out


def paragraphs(text: str) -> list[list[str]]:
    """The leaves of each paragraph; joined, they are the text."""
    out, places, i = [], cut_places(text), 0
    for line in _LINE.finditer(text):
        at, end, own = line.start(), line.end(), []
        while i < len(places) and places[i] < end:
            place, i = places[i], i + 1
            while place - at > MAX_LEAF:
                own.append(text[at : at + MAX_LEAF])
                at += MAX_LEAF
            if place - at >= MIN_LEAF:
                own.append(text[at:place])
                at = place
        while end - at > MAX_LEAF:
            own.append(text[at : at + MAX_LEAF])
            at += MAX_LEAF
        if at < end:
            own.append(text[at:end])
        out.append(own)
    return out


def fingerprint(text: str | None) -> str:
    from xxhash import xxh3_128_digest as digest

    sections, nodes, shown, own = [], [], [], []

    def close() -> None:
        nodes.append(digest(b"section" + b"".join(own)))
        sections.append(f"{nodes[-1].hex()[:8]}={'|'.join(shown)}")
        own.clear()
        shown.clear()

    for part in paragraphs(text or ""):
        below = [digest(leaf.encode()) for leaf in part]
        leaves = ",".join(d.hex()[:8] + _base36(len(leaf)) for d, leaf in zip(below, part, strict=True))
        node = digest(b"paragraph" + b"".join(below))
        own.append(node)
        shown.append(leaves if len(part) == 1 else f"{node.hex()[:8]}-{leaves}")
        if node[0] % SECTION_CUT == 0 or part[-1].endswith("\n\n"):
            close()
    if own:
        close()
    return digest(b"root" + b"".join(nodes)).hex() + ":" + ";".join(sections)


#: A node of a parsed fingerprint: its digits (a leaf's with its length), its length in characters, its children.
Node = tuple[str, int, list]


def parse(fp: str) -> tuple[str, list[Node]]:
    """(root, sections)."""
    root, _, rest = fp.partition(":")
    sections = []
    for section in rest.split(";") if rest else ():
        name, _, parts = section.partition("=")
        below = []
        for part in parts.split("|"):
            own, dash, leaves = part.rpartition("-")
            kids = [(leaf, int(leaf[8:], 36), []) for leaf in leaves.split(",")]
            below.append((own if dash else leaves, sum(k[1] for k in kids), kids))
        sections.append((name, sum(b[1] for b in below), below))
    return root, sections


def compare(a: str, b: str) -> tuple[int, int, list[tuple[int, int]]]:
    """(characters that a and b share, characters of both, spans of a that b doesn't have), by descent into unequal branches."""
    (ra, sa), (rb, sb) = parse(a), parse(b)
    total = sum(n[1] for n in sa) + sum(n[1] for n in sb)
    if ra == rb:
        return total // 2, total, []
    left: list[tuple[int, Node]] = []  # with its place in the text
    at = 0
    for node in sa:
        left.append((at, node))
        at += node[1]
    right, shared = sb, 0
    for level in range(3):
        have = Counter(n[0] for n in right)
        met, rest = Counter(), []
        for at, node in left:
            if have[node[0]] > 0:
                have[node[0]] -= 1
                met[node[0]] += 1
                shared += node[1]
            else:
                rest.append((at, node))
        other = []
        for node in right:
            if met[node[0]] > 0:
                met[node[0]] -= 1
            else:
                other.append(node)
        if level == 2:
            left = rest
            break
        left, right = [], [k for n in other for k in n[2]]
        for at, node in rest:
            for k in node[2]:
                left.append((at, k))
                at += k[1]
    spans: list[tuple[int, int]] = []
    for at, node in left:
        if spans and spans[-1][1] == at:
            spans[-1] = spans[-1][0], at + node[1]
        else:
            spans.append((at, at + node[1]))
    return shared, total, spans


def likeness(a: str, b: str) -> float:
    if a.partition(":")[0] == b.partition(":")[0]:
        return 1.0
    shared, total, _ = compare(a, b)
    return min(2.0 * shared / total, 1.0 - 1e-9) if total else 0.0


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """Code point spans of a's text that b doesn't have."""
    return compare(a, b)[2]


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, tie, chunk, ahead: documents dealt by order into chunks, each chunk followed (ahead) by the row that comes after it.

    Only ids and text hashes are put in order as a whole; the texts move once. Chunk bounds are one key a partition.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").isNull().alias("none"), (-F.col("doc_id").cast("long")).alias("neg"), F.col("tie")]
    keys = keyed.select(*order).distinct().repartitionByRange(n, "none", "neg", "tie")
    firsts = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("none", "neg", "tie")).alias("first"))
    bounds = sorted((r.first.none, r.first.neg or 0, r.first.tie) for r in firsts.select("first").collect())  # at most n

    @F.pandas_udf("array<int>")
    def places(doc_id, tie):
        import pandas as pd

        out = []
        for d, t in zip(doc_id, tie, strict=True):
            key = (True, 0, int(t)) if pd.isna(d) else (False, -int(d), int(t))
            at = bisect.bisect_right(bounds, key) - 1
            out.append([2 * at, 2 * ((at - 1) % len(bounds)) + 1] if bounds[at] == key else [2 * at])
        return pd.Series(out)

    placed = keyed.select("doc_id", "text", "tie", F.explode(places(F.col("doc_id").cast("long"), "tie")).alias("place"))
    placed = placed.select("doc_id", "text", "tie", F.expr("place div 2").cast("int").alias("chunk"), (F.col("place") % 2).alias("ahead"))
    # A chunk is a partition; by its hash, several would meet in one task.
    return placed.repartitionById(n, "chunk").sortWithinPartitions("chunk", "ahead", F.col("doc_id").desc_nulls_last(), "tie", "text")


def edit(text: str, following: str) -> str:
    """text with its last third replaced by the start of the following one."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document, and
    edited_spans: where its text isn't in the edited one, as `start-end,start-end...` in code points."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_spans"]

    def one(doc_id, text: str, own: str, following: str, their: str) -> tuple:
        edited = edit(text, following)
        other = own if edited == text else fingerprint(edited)
        spans = ",".join(f"{x}-{y}" for x, y in differences(own, other))
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, likeness(own, other), likeness(own, their), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None  # (chunk, doc_id, text, fingerprint) that waits for the row after it
        for batch in batches:
            for part in pieces(batch, "text"):
                out = []
                for doc_id, text, chunk, ahead in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "chunk", "ahead")), strict=True):
                    text = text or ""
                    own = fingerprint(text) if not ahead or pending else None
                    if pending:
                        out.append(one(*pending[1:], text, own))
                    pending = None if ahead else (chunk, doc_id, text, own)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(names), schema, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", _arrow(docs, "doc_id")), ("n_chars", pa.int64()), *((c, pa.string()) for c in names[2:5]), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edited_spans", pa.string())])
    return neighbours(docs).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_spans string")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from .common import to_arrow

    return to_arrow(df.schema[column].dataType)
