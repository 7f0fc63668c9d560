"""The two statements of what a word is."""

import numpy as np
import pyarrow as pa

from cataloom.llm import _bytes


def test_words_as_by_rule():
    texts = ["Ab, cd-ÉF 12", "", None, "ª µ º §x’y　z", "a\nb  a"]
    hashes, bounds = _bytes.word_batch(pa.array(texts, pa.string()))
    words = [w for t in texts for w in _bytes.words_of(t)]
    assert np.diff(bounds).tolist() == [len(_bytes.words_of(t)) for t in texts]
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
