"""Sequences numbered as they are due."""

import numpy as np
import pyarrow as pa

from tarnql.llm.packing import _assign_in_turn, _layout, encoder


class Shared:
    def __init__(self, value):
        self.value = value


def test_places_are_filled_once_and_in_order():
    """Every place of every pattern is taken by one piece, and pieces of a kind come in the order of their ranks."""
    made = [(70, {9: 1, 3: 2}), (41, {9: 2}), (1, {3: 5}), (260, {12: 1}), (1, {3: 1, 9: 1})]
    demand = {9: 70 + 82 + 1, 3: 140 + 5 + 1, 12: 260}
    kind = np.concatenate([np.full(n, k) for k, n in demand.items()])
    rank = np.concatenate([np.arange(n) for n in demand.values()])
    batch = pa.RecordBatch.from_arrays([pa.array(kind), pa.array(rank)], ["kind", "rank"])
    out = next(_assign_in_turn(Shared(_layout(made)))(iter([batch])))
    seq, slot = out.column(2).to_numpy(), out.column(3).to_numpy()
    assert len(set(zip(seq.tolist(), slot.tolist(), strict=True))) == len(kind)
    assert sorted(set(seq.tolist())) == list(range(sum(n for n, _ in made)))
    for k in demand:
        assert (np.diff(seq[kind == k]) >= 0).all()
    content = {}
    for s, k in zip(seq.tolist(), kind.tolist(), strict=True):
        content.setdefault(s, []).append(k)
    assert sorted(map(sorted, content.values())) == sorted(sorted(k for k, c in p.items() for _ in range(c)) for n, p in made for _ in range(n))


def test_long_blank_runs_are_encoded():
    """Where the fast encoder gives up the tokenizers library takes over."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, plain = encoder(path), Tokenizer.from_file(path)
    for text in (" " * 1_200_000, "\n" * 2_000_000):
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
