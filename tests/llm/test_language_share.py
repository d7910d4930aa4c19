import numpy as np

from termloom.llm import langid


def test_small_share_of_a_long_text_stays():
    ll = np.full((3, 20_000), -9.0, np.float32)
    ll[0] = -4
    ll[:2, :380] = [[-9.0], [-4.0]]
    chosen, shares = langid.mixtures(ll, np.array([0, 20_000]))
    assert chosen[:, 0].tolist() == [True, True, False] and 0 < shares[1, 0] < 0.02
