"""MinHash fingerprints of documents, and how alike neighbours and edited texts look by them.

A text is the set of its shingles of five words.  Each of ``PERMUTATIONS``
multiply-shift hashes, drawn from a universal family, ranks the shingles; the
least rank of each is a slot of the signature, and the share of equal slots of
two signatures estimates the Jaccard similarity of their sets.  Fingerprints show
the upper 16 bits of each rank: other ranks look equal once in 65,536 slots.

Whole texts move once, compressed by their tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import Batches, arrow_map, partitions_for, require
from .words import text_words, windows

PERMUTATIONS = 64
SHINGLE_WORDS = 5
#: Texts of this many bytes go to one partition.
BYTES_PER_PARTITION = 32 << 20
_SHINGLES_AT_ONCE = 1 << 16
_DOCS_AT_ONCE = 256

_rng = np.random.Generator(np.random.PCG64(20_11))
_FACTORS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2)
EMPTY = np.uint64((1 << 64) - 1)


def shingle_hashes(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """A hash per shingle; fewer words than a shingle has are one shingle, no words none."""
    return windows(words, min(size, len(words))) if len(words) else words


def signatures(sets: Sequence[np.ndarray]) -> np.ndarray:
    """A row of ``PERMUTATIONS`` least ranks (64 bits) per set of shingle hashes; empty sets have ``EMPTY``."""
    result = np.full((len(sets), PERMUTATIONS), EMPTY)
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def settle() -> None:
        owners = np.array([o for o, _ in held])
        values = np.concatenate([x for _, x in held])
        starts = np.cumsum([0, *[len(x) for _, x in held[:-1]]])
        rank = np.empty_like(values)
        for k in range(PERMUTATIONS):
            np.multiply(values, _FACTORS[k], out=rank)
            np.add(rank, _TERMS[k], out=rank)
            np.minimum.at(result[:, k], owners, np.minimum.reduceat(rank, starts))

    for owner, values in enumerate(sets):
        for low in range(0, len(values), _SHINGLES_AT_ONCE):
            held.append((owner, values[low : low + _SHINGLES_AT_ONCE]))
            size += len(held[-1][1])
            if size >= _SHINGLES_AT_ONCE:
                settle()
                held, size = [], 0
    if held:
        settle()
    return result


def slots(signature: np.ndarray) -> np.ndarray:
    """The upper 16 bits of each least rank."""
    return (signature >> np.uint64(48)).astype(">u2")


def normalized(text: str) -> list[bytes]:
    """Words of the text, A-Z in lower case, parted at ASCII white space."""
    return text.encode().lower().split()


def _edited(text: str, following: str) -> tuple[str, str, str]:
    """What stays of the text, what comes in its place at the end, and both together."""
    replaced = len(text) // 4
    stays, comes = text[: len(text) - replaced], following[:replaced]
    return stays, comes, stays + comes


#: While rows wait for their neighbours, digests are bytes: half of what their digits take.
_RESULT = (
    "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double, text_key binary"
)
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _compare(ids: Sequence[int | None], texts: Sequence[str], size: int) -> list[tuple]:
    """Result rows of all texts but the last, each with the one after it as the next document."""
    sets, edits, words = [], [], []
    for text in texts:
        words.append(text_words([text.encode()])[0])
    for text, following, own in zip(texts, texts[1:], words, strict=False):
        stays, comes, edited = _edited(text, following)
        edits.append(hashlib.sha256(edited.encode()).digest())
        kept = normalized(stays)
        same = max(len(kept) - 1, 0)  # the last word that stays may go on in what comes
        if same < size:
            sets += [own[:0], shingle_hashes(own, size), shingle_hashes(text_words([edited.encode()])[0], size)]
            continue
        joint = b" " if stays[-1] in " \t\n\x0b\x0c\r" else b""
        rest = text_words([kept[-1] + joint + comes.encode()])[0]
        seam = own[same - size + 1 : same]  # shingles of the words before are in both texts
        tails = [np.concatenate([seam, x]) for x in (own[same:], rest)]
        sets += [shingle_hashes(own[:same], size), *[shingle_hashes(x, size) if len(x) >= size else x[:0] for x in tails]]
    sets.append(shingle_hashes(words[-1], size))
    found = signatures(sets)
    last = slots(found[-1])
    common, full, new = found[:-1:3], found[1:-1:3], found[2:-1:3]
    own = [*slots(np.minimum(common, full)), last]
    changed = slots(np.minimum(common, new))
    return [
        (doc_id, len(text), sha, a.tobytes(), b.tobytes(), float(np.mean(a == b)), float(np.mean(a == c)),
         hashlib.md5(text.encode()).digest())
        for doc_id, text, sha, a, b, c in zip(ids, texts, edits, own, changed, own[1:], strict=False)
    ]


def _columns(rows: list[tuple], kinds: Sequence[pa.DataType], names: Sequence[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.binary()]
_SEAM_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string()]
_SEAM_NAMES = ["part", "first_text", "last_id", "last_text"]


def _packed(batches: Batches) -> Batches:
    for batch in batches:
        texts = [zstandard.compress(x.encode(), 1) for x in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tie"], pa.array(texts, pa.binary())], ["doc_id", "tie", "packed"])


def _sliding(size: int):
    """Rows of a sorted partition but its last, and one row with what the seams to its neighbours need."""
    empty = [None] * len(_SEAM_NAMES)

    def rows(batches: Batches) -> Iterator[tuple[int | None, str]]:
        for batch in batches:
            for doc_id, packed in zip(batch["doc_id"].to_pylist(), batch["packed"], strict=True):
                yield doc_id, zstandard.decompress(packed.as_py()).decode()

    def run(batches: Batches) -> Batches:
        ids, texts, first, length = [], [], None, 0
        for doc_id, text in rows(batches):
            first = text if first is None else first
            ids.append(doc_id)
            texts.append(text)
            length += len(text)
            if len(texts) > 1 and (len(texts) > _DOCS_AT_ONCE or length > BYTES_PER_PARTITION):
                found = _compare(ids[:-1], texts, size)
                yield _columns([(*x, *empty) for x in found], [*_KINDS, *_SEAM_KINDS], [*_NAMES, *_SEAM_NAMES])
                ids, texts, length = ids[-1:], texts[-1:], len(texts[-1])
        if first is None:
            return
        found = [(*x, *empty) for x in _compare(ids[:-1], texts, size)] if len(texts) > 1 else []
        seam = (TaskContext.get().partitionId(), first, ids[-1], texts[-1])
        found.append((*[None] * len(_NAMES), *seam))
        yield _columns(found, [*_KINDS, *_SEAM_KINDS], [*_NAMES, *_SEAM_NAMES])

    return run


def _across(size: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = [
                _compare([x["last_id"]], [x["last_text"], x["next_text"]], size)[0] for x in batch.to_pylist()
            ]
            yield _columns(rows, _KINDS, _NAMES)

    return run


def fingerprint_changes(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprint of each text and of its edited text, and how alike they and the next document's are.

    The edited text has its last ``floor(n_chars / 4)`` code points replaced by
    the first as many, or all, of the next document, in ascending order of
    ``doc_id``; the first document follows the last.  Columns ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint`` (lowercase hexadecimal),
    ``near_edited, near_next`` (share of equal slots), ``text_key`` (md5).  Null
    texts are empty; rows without id come first; rows with the same id follow
    each other by a hash of their text; a single row is its own next one; an
    empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    require(docs, [id_col, text_col])
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    order = ["doc_id", "tie"]
    packed = arrow_map(texts.withColumn("tie", F.xxhash64("text")), _packed, "doc_id long, tie long, packed binary")
    ordered = packed.repartitionByRange(
        partitions_for(spark, size, BYTES_PER_PARTITION), *order
    ).sortWithinPartitions(*order)
    seams = ", part long, first_text string, last_id long, last_text string"
    found = materialize(
        arrow_map(ordered.select("doc_id", "packed"), _sliding(shingle_words), _RESULT + seams), "fingerprint_changes"
    )
    cuts = found.filter("part IS NOT NULL")
    # The order of the parts alone is one task's work: a number per part.
    parts = cuts.select("part").withColumn("next", F.lead("part").over(Window.orderBy("part")))
    parts = parts.withColumn("next", F.coalesce("next", F.min("part").over(Window.partitionBy())))
    firsts = cuts.select(F.col("part").alias("next"), F.col("first_text").alias("next_text"))
    lasts = cuts.select("part", "last_id", "last_text").join(parts, "part").join(firsts, "next")
    rest = arrow_map(lasts.select("last_id", "last_text", "next_text"), _across(shingle_words), _RESULT)
    whole = found.filter("part IS NULL").select(*_NAMES).unionByName(rest)
    digests = ("edited_sha256", "fingerprint", "edited_fingerprint")
    return whole.withColumns({c: F.lower(F.hex(c)) for c in digests})
