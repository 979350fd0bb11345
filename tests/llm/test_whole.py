"""Operators on what their fitted sample lacks."""

import numpy as np
import pytest

from seqloom.llm import toxicity


def test_unseen_ngrams_count_by_their_longest_known_suffix():
    levels = toxicity.ratios(["ab ab ac", "abc ab"], ["zb zb zc", "zbq zb"], 4)[2]
    tables = [[dict(zip(k.tolist(), p[c], strict=True)) for c in (0, 1)] for k, p, _, _ in levels]
    weights = [None] + [[dict(zip(h.tolist(), w[c], strict=True)) for c in (0, 1)] for _, _, h, w in levels[1:]]

    def brute(g, order, c):
        if g in tables[order - 1][c]:
            return tables[order - 1][c][g]
        if order == 1:
            return levels[0][3][c, 0]
        return weights[order - 1][c].get(g >> 8, 1.0) * brute(g & (1 << 8 * (order - 1)) - 1, order - 1, c)

    model = toxicity.ratios(["ab ab ac", "abc ab"], ["zb zb zc", "zbq zb"], 4)
    for text in ("xzbx", "zzb", "qq", "abzb ac"):
        g = toxicity.grams(text, 4)
        want = [np.log(brute(int(x), 4, 1) / brute(int(x), 4, 0)) for x in g]
        assert any(int(x) not in tables[3][0] for x in g)
        assert toxicity.features(text, model, 4, [3])[0] == pytest.approx(np.mean(want), abs=1e-6)
    assert toxicity.features("xzbx", model, 4, [3])[0] > 0  # "xzb" is in no sample, "zb" only in the toxic one


def test_probabilities_after_a_context_add_up_to_one():
    keys, _, levels = toxicity.ratios(["ab ab ac", "abc ab"], ["zb zb zc", "zbq zb"], 4)
    bytes_known = levels[0][0]
    for h in np.unique(keys >> np.uint64(8)):
        assert toxicity.backed_off((h << np.uint64(8)) | bytes_known, levels).sum(1) == pytest.approx([1, 1])
