import numpy as np
import pytest

from foliospark.functions import imaging as im


def picture(h=60, w=40, seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 255, (h, w, 3), dtype=np.uint8)


def test_canonical_hash_survives_rotation():
    image = picture()
    assert len({im.canonical_phash(im.rotate_label(image, a)) for a in (0, 90, 180, 270)}) == 1
    assert 0 <= im.phash(image) < 1 << 63


def test_gray_and_area_means_round_as_published():
    pure = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255], [1, 1, 1]]], np.uint8)
    assert im.gray(pure).tolist() == [[29, 150, 76, 255, 1]]
    tile = lambda cell, n: np.tile(np.array(cell, np.uint8), (n, n))
    assert set(im.shrink(tile([[0, 1], [1, 0]], 32), 32).ravel()) == {1}  # one half, of 2 x 2 pixels: up
    assert set(im.shrink(tile([[0, 1], [1, 0]], 64), 32).ravel()) == {0}  # one half, of 4 x 4: to the even one
    assert set(im.shrink(tile([[1, 2], [2, 1]], 64), 32).ravel()) == {2}
    assert set(im.shrink(tile([[0, 0, 4], [4, 4, 4], [4, 4, 4]], 32), 32).ravel()) == {3}  # 28 / 9


def test_hashes_worked_out_by_hand():
    # A step from dark to light has the odd frequencies across it only: the third and seventh above 0, the first and fifth below.
    step = np.zeros((32, 32, 3), np.uint8)
    step[:, 16:] = 200
    want = {0: 0x1100000000000000, 90: 0x0000008000000080, 180: 0x4400000000000000, 270: 0x0080000000800000}
    for size in (1, 2, 5):
        large = step.repeat(size, axis=0).repeat(size, axis=1)
        assert {a: im.phash(im.rotate_label(large, a)) for a in want} == want
        assert {im.canonical_phash(im.rotate_label(large, a)) for a in want} == {0x0000008000000080}
    assert im.phash(np.full((40, 50, 3), 90, np.uint8)) == 0
    for h, w in ((33, 47), (64, 64), (101, 64), (31, 200)):
        assert len({im.canonical_phash(im.rotate_label(picture(h, w, h), a)) for a in (0, 90, 180, 270)}) == 1


def test_rotate_label_is_clockwise():
    assert im.rotate_label(np.array([[1, 2], [3, 4]]), 90).tolist() == [[3, 1], [4, 2]]
    with pytest.raises(ValueError):
        im.rotate_label(picture(), 45)


def test_resize_and_dct():
    ones = np.full((50, 70), 7.0)
    assert np.allclose(im.resize_area(ones, 32, 32), 7)
    assert np.allclose(im.dct2(np.full((32, 32), 2.0)).ravel()[1:], 0) and im.dct2(np.full((32, 32), 2.0))[0, 0] == pytest.approx(64)


def test_regions_and_crops():
    mask = np.zeros((20, 20), bool)
    mask[2:5, 2:5], mask[10:18, 8:12], mask[17, 12:15] = True, True, True
    region = im.largest_region(mask)
    assert region.sum() == 8 * 4 + 3 and not region[2, 2]
    assert im.crop_to_mask(picture(20, 20), mask, 1).shape == (10, 9, 3)
    assert im.crop_to_mask(picture(20, 20), np.zeros((20, 20), bool)) is None
    assert im.apply_mask(picture(20, 20), np.zeros((5, 5), bool)).sum() == 0


def test_angles():
    page = np.zeros((200, 200), np.uint8)
    page[60:140, 30:170] = 255
    turned = im.rotate_keep_canvas(page, 10)
    assert abs(abs(im.coarse_angle(turned)) - 10) < 1.5
    text = np.full((120, 200), 255, np.uint8)
    text[20:110:12, 20:180] = 0
    text[21:110:12, 20:180] = 0
    angle, _ = im.refine_angle(im.rotate_keep_canvas(text, 1.0), 0.0)
    assert abs(angle + 1.0) <= 0.4


def test_enhance_and_otsu():
    two = np.concatenate([np.full(50, 10, np.uint8), np.full(50, 200, np.uint8)]).reshape(10, 10)
    assert 10 <= im.otsu(two) < 200
    out = im.enhance(picture(64, 64))
    assert out.shape == (64, 64) and out.dtype == np.uint8
    assert im.model_input(picture(), 16).shape == (3, 16, 16)


def test_mask_visual_draws_the_border():
    mask = np.zeros((10, 10), bool)
    mask[2:8, 3:9] = True
    plain, drawn = im.mask_visual(np.zeros((20, 20, 3), np.uint8), mask)
    assert plain.shape == (20, 20) and set(np.unique(plain)) == {0, 255} and (plain > 0).sum() == 144
    assert (drawn[..., 1] == 255).sum() == 44 and drawn[4, 6].tolist() == [0, 255, 0] and not drawn[8, 10].any()
    assert not im.mask_visual(np.zeros((4, 4), np.uint8), np.zeros((2, 2), bool))[1].any()
