"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Texts and templates become sequences of hashes of ``SIZE``-word shingles (words
lower-cased, ASCII punctuation apart). A template of s distinct shingles is looked
for in windows of s shingles that start every max(1, s // 4). Each of ``BANDS`` bands
has one row, the least shingle of the window under the band's hash; a window
retrieves a template when a band agrees. A window shifted by at most s / 8 from a
verbatim copy has a Jaccard of 7/9 or more, and agrees in some band with a probability of
at least 1 - (2/9)^12 > 0.99999998; at a Jaccard of 0.5 it is 0.9997.

A band agrees only where the template's least shingle stands in the window, so
windows are evaluated around such shingles and all others are known to disagree.

A retrieved template is verified around the window: its share of shingles found
there must be ``min_containment`` or more. Licenses quote each other, so of verified
places that overlap, the template with the most shingles found stays: one that lies by
more than half its words within places of better ones is dropped. Templates are short
notices, openings, standard headers and whole texts (``license_texts``).

Defined cases: null and empty texts match nothing; texts under ``SIZE`` words match
nothing; a template of fewer words is an error; repeated rows are scanned one by one;
extra columns are ignored; ties between places of a template go to the first, ties
between templates to the earlier template.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.decontaminate import words
from lodestone.llm.common import mix
from lodestone.llm.license_texts import TEMPLATES

SIZE = 5
BANDS = 12


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the word shingles of a text, in order."""
    own = words(text)
    if len(own) < SIZE:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    out = np.full(len(own) - SIZE + 1, 1, np.uint64)
    for i in range(SIZE):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - SIZE + 1 + i])
    return out


_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


class Index:
    """Templates by the least shingle of each band."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names, self.sets, self.anchors = list(templates), [], {}
        for t, text in enumerate(templates.values()):
            own = np.unique(shingles(text))
            if not len(own):
                raise ValueError(f"template {self.names[t]} has under {SIZE} words")
            self.sets.append(own)
            for j, seed in enumerate(_SEEDS):
                least = int(own[np.argmin(mix(own ^ seed))])
                self.anchors.setdefault(least, []).append((t, j))
        self.keys = np.array(sorted(self.anchors), np.uint64)

    def retrieve(self, found: np.ndarray) -> set[tuple[int, int]]:
        """(template, window start) where a band of the window agrees with the template."""
        out = set()
        for p in np.flatnonzero(np.isin(found, self.keys)):
            value = found[p]
            for t, j in self.anchors[int(value)]:
                width = len(self.sets[t])
                step = max(1, width // 4)
                low, seed = max(0, int(p) - width + 1), _SEEDS[j]
                for start in range(-(-low // step) * step, int(p) + 1, step):
                    if (t, start) not in out and mix(found[start : start + width] ^ seed).min() == mix(value[None] ^ seed)[0]:
                        out.add((t, start))
        return out

    def verify(self, found: np.ndarray, t: int, start: int) -> tuple[float, int, int]:
        """(containment, first word, word after the last) of a template around a window."""
        width = len(self.sets[t])
        low, high = max(0, start - width // 2), min(len(found), start + width + width // 2 + 1)
        at = np.flatnonzero(np.isin(found[low:high], self.sets[t]))
        share = len(np.unique(found[low:high][at])) / width
        return share, low + int(at[0]) if len(at) else start, low + int(at[-1]) + SIZE if len(at) else start

    def places(self, found: np.ndarray, min_containment: float) -> list[tuple[int, float, int, int]]:
        """(template, containment, first word, word after the last) of each verified window, but those that a better template owns."""
        rows = [(t, start, *self.verify(found, t, start)) for t, start in self.retrieve(found)]
        sound = [r for r in rows if r[2] >= min_containment]
        owner = np.full(len(found) + SIZE, -1, np.int64)
        out = []
        for t, _, share, first, end in sorted(sound, key=lambda r: (-r[2] * len(self.sets[r[0]]), r[0], r[1])):
            held = owner[first:end]
            if 2 * np.count_nonzero((held >= 0) & (held != t)) > end - first:
                continue
            held[held < 0] = t
            out.append((t, share, first, end))
        return out


MATCHES = "doc_id bigint, license_id string, containment double, first_word bigint, end_word bigint, n_windows bigint"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_containment: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, license_id, containment, first_word, end_word, n_windows): each license found, at its best and first place."""
    known = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(known)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                found = shingles(text.as_py())
                best: dict[int, tuple] = {}
                for t, share, first, end in index.places(found, min_containment):
                    old = best.get(t, (0.0, 0, 0, 0))
                    best[t] = (*max(old[:3], (share, first, end), key=lambda x: (x[0], -x[1], -x[2])), old[3] + 1)
                rows += [(key.as_py(), index.names[t], *b) for t, b in sorted(best.items())]
            if rows:
                types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                names = [f.split()[0] for f in MATCHES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL").mapInArrow(run, MATCHES)
