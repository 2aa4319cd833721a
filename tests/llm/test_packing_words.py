"""What a packing worker keeps in memory: words that come again, not every word that it meets."""

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import packing


def test_words_met_once_are_not_kept():
    path = pytest.importorskip("public_tokenizers").path(packing.TOKENIZER)
    from tokenizers import Tokenizer

    words, plain = packing.Words(path), Tokenizer.from_file(path)
    for k in range(3):
        texts = [" ".join(f"w{k}x{i}y{j} The often, q{k}zz{i % 7}" for j in range(20)) for i in range(200)] + ["", "The often,"]
        ids, at = words.encode(pa.array(texts))
        want = plain.encode_batch(texts, add_special_tokens=False)
        assert ids.tolist() == [x for e in want for x in e.ids] and np.diff(at).tolist() == [len(e.ids) for e in want]
    assert len(words.known) < 100  # 12,000 words were met once
    assert len(words.begin) == len(words.size) == max(words.known.values()) + 1
