"""Every replacement that the verification accepts is found in short items."""

from itertools import combinations

import numpy as np
import pytest

from riskflow.llm import decontaminate
from riskflow.llm.blocks import Block


def found(items, texts):
    raw = [t.encode() for t in texts]
    b = Block(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), {})
    d, i, n = decontaminate.Items(list(range(len(items))), items).match(*decontaminate.token_hashes(b))
    return set(zip(d.tolist(), i.tolist(), n.tolist(), strict=True))


@pytest.mark.parametrize("size", range(8, 14))
def test_every_accepted_replacement(size):
    words = [f"b{i}" for i in range(size)]
    texts, want = [], set()
    for n in range(size // 2):
        for places in combinations(range(size), n):
            if 10 * (size - n) >= 8 * size:
                want.add((len(texts), 0, size - n))
            texts.append("before it " + " ".join("other" if k in places else w for k, w in enumerate(words)) + " after it")
    assert len(want) > size
    assert found([" ".join(words)], texts) == want


def test_items_under_eight_tokens_by_their_whole_run():
    items = [" ".join(f"b{i}" for i in range(n)) for n in (1, 2, 5, 7)]
    texts = ["c B0 c", "c b0, b1 c", "b0 b1 b2 b3 b4", "x b0 b1 b2 b3 b4 b5 b6 y", "b1 b2 b3 b4 b5 b6"]
    assert found(items, texts) == {(0, 0, 1), (1, 0, 1), (1, 1, 2), *((k, i, n) for k, m in ((2, 3), (3, 4)) for i, n in enumerate((1, 2, 5, 7)[:m]))}
