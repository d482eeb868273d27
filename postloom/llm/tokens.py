"""Token ids of whole texts with a byte-level BPE of the tokenizers library.

Such a tokenizer never joins a space and the visible character after it with what stands before, so the
ids of a text are the ids of its pieces between spaces, one after the other. Pieces repeat; each worker
encodes a piece once and looks it up from then on, in Arrow arrays that hold all its pieces and their ids.
Texts with a piece that is empty or starts with white space (several spaces in a row, a space before a line
end) are encoded as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from postloom.llm.common import worker_memory

#: Pieces in the cache of a worker beyond which the next slice drops those it does not use.
CACHE_PIECES = 600_000


def load_definition(path: str | None = None) -> str:
    """The tokenizer file as text; it travels with the tasks, so only the driver needs the file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_text(encoding="utf-8")


#: Text encoded at once; the ids of a slice need about ten times its bytes for a moment.
SLICE_BYTES = 8 << 20


class TextEncoder:
    """Ids of many texts at once; `end_id` follows each text."""

    def __init__(self, definition: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that start with a space
        self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.end = np.array([end_id], "<u4")
        # The cache: pieces, the number of ids of each, and all these ids one after the other.
        self.known = pa.array([], pa.string())
        self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    @staticmethod
    def of_worker(definition: str, end_id: int) -> TextEncoder:
        """The encoder of this Python worker; made by its first task."""
        kept, key = worker_memory(), ("encoder", hash(definition), end_id)
        if key not in kept:
            kept[key] = TextEncoder(definition, end_id)
        return kept[key]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in found]

    def _fresh(self, pieces: list[str], together: int = 200) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and their numbers for pieces with a space before them, by groups that are encoded as one text and
        cut where a token opens."""
        ids, lengths = [], []
        groups = [pieces[i:i + together] for i in range(0, len(pieces), together)]
        for at in range(0, len(groups), 64):
            some = groups[at:at + 64]
            for group, found in zip(some, self._whole([" " + " ".join(group) for group in some]), strict=True):
                starts = np.flatnonzero(self.opens[found])
                if len(starts) == len(group):
                    ids.append(found)
                    lengths.append(np.diff(starts, append=len(found)))
                else:
                    each = self._whole([" " + piece for piece in group])
                    ids += each
                    lengths.append(lengths_of(each))
        return ids, lengths

    def _places(self, pieces: pa.Array, odd: np.ndarray) -> np.ndarray:
        """Where each piece stands in the cache, which takes in the new ones; an odd piece stands nowhere (0)."""
        if len(self.known) > CACHE_PIECES:  # only what this slice uses is kept
            used = pc.index_in(self.known, value_set=pieces).is_valid().to_numpy(zero_copy_only=False)
            ends = np.cumsum(self.lengths)
            self.pool = self.pool[runs((ends - self.lengths)[used], self.lengths[used])]
            self.known, self.lengths = self.known.filter(pa.array(used)), self.lengths[used]
        places = pc.index_in(pieces, value_set=self.known)
        new = places.is_null().to_numpy(zero_copy_only=False) & ~odd
        places = pc.fill_null(places, 0).to_numpy().astype(np.int64)
        fresh = pieces.filter(pa.array(new))
        places[new] = len(self.known) + np.arange(len(fresh))
        ids, lengths = self._fresh(fresh.to_pylist())
        self.known = pa.concat_arrays([self.known, fresh])
        self.lengths = np.concatenate([self.lengths, *lengths])
        self.pool = np.concatenate([self.pool, *ids])
        return places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text starts in it (one more entry than texts)."""
        n = len(texts)
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(counts) - counts
        coded = split.flatten().dictionary_encode()
        codes, pieces = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        plain = pc.and_(pc.equal(pc.utf8_ltrim_whitespace(pieces), pieces), pc.not_equal(pieces, ""))
        odd = ~plain.to_numpy(zero_copy_only=False)
        places = self._places(pieces, odd)[codes]
        # The first piece of a text has no space before it; a text with an odd piece stands whole in its place.
        whole = np.logical_or.reduceat(odd[codes], first)
        heads = self._whole(pc.if_else(pa.array(whole), texts, pieces.take(pa.array(codes[first]))).to_pylist())
        known = len(self.known)
        places[np.repeat(whole, counts)] = known + n
        places[first] = known + np.arange(n)
        places = np.insert(places, first + counts, known + n + 1)
        lengths = np.concatenate([self.lengths, lengths_of(heads), [0, 1]])
        pool = np.concatenate([self.pool, *heads, self.end])
        n_ids = lengths[places]
        ids = pool[runs((np.cumsum(lengths) - lengths)[places], n_ids)]
        return ids, np.concatenate([[0], np.cumsum(n_ids)[np.cumsum(counts + 1) - 1]])


def lengths_of(arrays: list[np.ndarray]) -> np.ndarray:
    return np.fromiter(map(len, arrays), np.int64, len(arrays))


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions `starts[i], starts[i] + 1, ...`, `lengths[i]` of them, for every i."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def encoded(batches: Iterator[pa.RecordBatch], definition: str, end_id: int
            ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each slice of the batches with the ids of its texts and where each text starts among them."""
    import os

    from postloom.llm.common import text_slices

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    encoder = TextEncoder.of_worker(definition, end_id)
    for part in text_slices(batches, most=SLICE_BYTES):
        yield part, *encoder.encode(part.column("text"))
