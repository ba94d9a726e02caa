"""Token ids of Arrow text columns with the tokenizers library, every distinct stretch of a batch encoded once.

The vocabulary file used here splits at white space, so the ids of a text are those of its white-space stretches in order. Arrow splits and
dictionary-encodes a batch. A final run of ``.,;:!?`` after a letter is a piece of its own for the tokenizer too, so it is looked up apart
from its word. A word of plain Latin letters is looked up in lower case, as the tokenizer's own first step has it. A bounded cache,
an Arrow array of pieces beside one of their ids, is met by one hash join per batch; only new pieces reach the tokenizer, many at a time, plain ones joined by spaces, by the
same model without the steps that leave such words as they are; the ids that end a word tell them apart. A batch's ids are the cached
ones taken in the order of its words.
"""

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept per Python worker; when there are more, the older half stays.
CACHE = 500_000
MARKS = ".,;:!?"
MARKED = r"\pL[.,;:!?]+$"
PLAIN = "^[a-zA-ZÀ-ÖØ-öø-ÿ]+$"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    def __init__(self, vocabulary: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.cache = Tokenizer.from_file(vocabulary), cache
        self.words = Tokenizer.from_file(vocabulary)
        self.words.normalizer = normalizers.Sequence([])
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), letters])
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.pieces, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def ids_of(self, stretches: pa.Array) -> pa.Array:
        """The ids of each stretch as binary: those of its core, then those of its final marks."""
        marked = pc.match_substring_regex(stretches, MARKED)
        cores = pc.if_else(marked, pc.utf8_rtrim(stretches, MARKS), stretches)
        cores = pc.if_else(pc.match_substring_regex(cores, PLAIN), pc.utf8_lower(cores), cores)
        marks = pc.replace_substring_regex(stretches.filter(marked), r"(?s)^.*\pL", "")
        coded = pa.concat_arrays([cores, marks]).dictionary_encode()
        ids = pa.concat_arrays([self.lookup(coded.dictionary), pa.array([b""], pa.binary())])
        places = coded.indices.to_numpy()
        ends = np.full(len(stretches), len(ids) - 1)
        ends[marked.to_numpy(zero_copy_only=False)] = places[len(stretches) :]
        return pc.binary_join_element_wise(ids.take(pa.array(places[: len(stretches)])), ids.take(pa.array(ends)), b"")

    def lookup(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces, from the cache where it has them."""
        at = pc.index_in(pieces, value_set=self.pieces)
        missing = pc.is_null(at)
        at = pc.fill_null(at, 0).to_numpy().copy()
        new = pieces.filter(missing)
        if len(new):
            names, ids = self.encode_pieces(new)
            at[missing.to_numpy(zero_copy_only=False)] = len(self.pieces) + pc.index_in(new, value_set=names).to_numpy()
            self.pieces, self.ids = pa.concat_arrays([self.pieces, names]), pa.concat_arrays([self.ids, ids])
        found = self.ids.take(pa.array(at))
        if len(self.pieces) > self.cache:
            self.pieces, self.ids = self.pieces.slice(0, self.cache // 2), self.ids.slice(0, self.cache // 2)
        return found

    def encode_pieces(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(pieces, ids) in an order of its own."""
        plain = pc.match_substring_regex(pieces, PLAIN)
        other, plain = pieces.filter(pc.invert(plain)).to_pylist(), pieces.filter(plain).to_pylist()
        names, ids, lengths = [], [], []
        for i in range(0, len(plain), 1_000):
            some = plain[i : i + 1_000]
            found = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends_word[found]) + 1
            if len(ends) != len(some):  # a vocabulary without word ends
                other += some
                continue
            names += some
            ids.append(found)
            lengths.append(np.diff(ends, prepend=0))
        for i in range(0, len(other), 1_000):
            some = other[i : i + 1_000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            names += some
            ids.append(np.array([x for f in found for x in f], self.kind))
            lengths.append(np.array([len(f) for f in found], np.int64))
        return pa.array(names, pa.string()), as_binary(ids, lengths, self.kind)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids): all ids in one array, each text followed by ``end_id``; ends of texts in it. Null counts as empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        word_ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        ids = pa.concat_arrays([self.ids_of(coded.dictionary), pa.array([np.array([end_id], self.kind).tobytes()], pa.binary())])
        order = np.insert(coded.indices.to_numpy(), word_ends, len(ids) - 1)
        taken = ids.cast(pa.large_binary()).take(pa.array(order))
        offsets = np.frombuffer(taken.buffers()[1], np.int64, len(order) + 1) // self.kind.itemsize
        return offsets[word_ends + np.arange(1, len(word_ends) + 1)], np.frombuffer(taken.buffers()[2] or b"", self.kind, offsets[-1])


def as_binary(ids: list[np.ndarray], lengths: list[np.ndarray], kind: np.dtype) -> pa.Array:
    """Runs of numbers, given by their lengths, as one binary value each."""
    data = np.concatenate([np.empty(0, kind), *ids])
    offsets = np.cumsum(np.concatenate([[0], *lengths]), dtype=np.int64) * kind.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One per Python worker and vocabulary."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 4 << 20):
    """The batch in runs of rows with about so many bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // most_bytes
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(sizes)]):
        yield batch.slice(int(a), int(b - a))
