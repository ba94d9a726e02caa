"""Word counts by batch and dense rows of common terms."""

import numpy as np
import pyarrow as pa
import pytest

from carrierlake.llm import toxicity

ODD = ["", None, "Straße ÀÉ÷× ab_c d2e x\x1cy", "ΟΔΟΣ ΣΑΣ. İI ǅ", "a² ⅷ º1 x٣y", "日本 語, 日本", "\n\tab  Ab AB.\n", "é é  ab"]


def test_vectors_of_a_batch_are_those_of_its_texts():
    counts = [toxicity.word_counts(t or "") for t in ODD]
    words = sorted({w for c in counts for w in c})[::2]
    vocabulary = toxicity.Vocabulary(words)
    ends, terms, times = vocabulary.vectors(pa.array(ODD))
    for count, a, b in zip(counts, [0, *ends], ends):
        assert dict(zip(terms[a:b].tolist(), times[a:b].tolist())) == {words.index(w): n for w, n in count.items() if w in words}
        assert (np.diff(terms[a:b]) > 0).all()
    assert len(vocabulary.vectors(pa.array([], pa.string()))[0]) == 0


@pytest.mark.parametrize("block", [2, 64])
def test_dense_rows_and_lists_give_whole_cosines(block):
    """Common terms in dense rows and rare ones in lists: the sums of both are the cosines of all pairs."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        terms = np.unique(np.append(rng.integers(0, 12, 6), rng.integers(12, 3000, 5)))
        rows.append((terms, rng.integers(1, 4, len(terms)), 1, int(rng.random() < 0.4), i))
    value = rng.random(3000) + 0.5
    index = toxicity.Index(value, toxicity.Entries(rows), 0.4, k=7, block=block)
    e = index.entries
    assert 0 < len(index.dense[1]) <= toxicity.DENSE and (index.dense[0][:12] >= 0).all() and (index.dense[0] < 0).any()
    whole = np.zeros((len(e), 3000))
    for i in range(len(e)):
        whole[i, e.row(i)[0]] = toxicity.unit_weights(*e.row(i), value)
    asked = [e.row(i) for i in range(0, len(e), 3)]
    for (terms, counts), (found, cosines) in zip(asked, index.all_nearest(asked), strict=True):
        want = whole[:, terms] @ toxicity.unit_weights(terms, counts, value)
        kth = np.sort(want)[::-1][6]
        assert set(np.flatnonzero(want > kth + 1e-8)) <= set(found) and np.allclose(cosines, want[found], atol=1e-12)
        assert len(found) >= 7
