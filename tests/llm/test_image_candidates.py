"""Candidates of image copies: what is compared bit by bit is not sorted first."""

from __future__ import annotations

import numpy as np

from pluvia.llm import image_copies as I


def test_crowded_bands_are_compared_before_they_are_sorted(monkeypatch):
    """300 query descriptors share a band with 200 stored ones: of 60,000 candidates only the close ones are told apart."""
    rng = np.random.default_rng(5)
    code, mine = rng.integers(0, 256, (300, 32), np.uint8), rng.integers(0, 256, (200, 32), np.uint8)
    code[:, :3] = mine[:, :3] = 77  # the first 24 bits: a whole band
    mine[:20] = code[10:30]  # close ones, which agree in all bands
    mine[:20, 20] ^= 255
    bands = I._bands(code)
    order = np.argsort(bands, axis=0, kind="stable")
    table = np.take_along_axis(bands, order, 0)
    filled = np.zeros((I.BANDS, 1 << I.BAND_BITS), bool)
    for k in range(I.BANDS):
        filled[k][table[:, k]] = True
    who, band, first, n = I._candidates(mine, table, filled)
    assert n.sum() >= 60_000
    sizes, real = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, *rest, **more: sizes.append(np.size(x)) or real(x, *rest, **more))
    flat = np.ascontiguousarray(order.T).ravel()
    image, place = np.arange(len(mine)), np.ones((len(code), 4), np.float32)
    found = list(I._agreeing(mine, image, np.ones((len(mine), 4), np.float32), who, flat, band * len(code) + first, n, code.view(np.uint64), np.arange(len(code)), place, len(code), 40, 1))
    far = np.unpackbits(mine[:, None] ^ code[None], axis=2).sum(2)
    assert sorted((i, q) for i, q, *_ in found) == sorted(map(tuple, np.argwhere(far <= 40).tolist())) and len(found) == 20
    assert max(sizes) < 1000
