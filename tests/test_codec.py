import pytest
from hypothesis import given
from hypothesis import strategies as st

from braidlog.functions import codec as C

ints = st.integers(-(1 << 63), (1 << 63) - 1)


@pytest.mark.parametrize("n,b", [(0, "00"), (127, "7f"), (128, "8001"), (624485, "e58e26")])
def test_uleb128_vectors(n, b):
    assert C.uleb128(n).hex() == b and C.read_uleb128(bytes.fromhex(b)) == (n, len(b) // 2)


@pytest.mark.parametrize("n,b", [(0, "00"), (-1, "7f"), (63, "3f"), (64, "c000"), (-64, "40"), (-65, "bf7f"), (-123456, "c0bb78")])
def test_sleb128_vectors(n, b):
    assert C.sleb128(n).hex() == b and C.read_sleb128(bytes.fromhex(b)) == (n, len(b) // 2)


def test_cut_off_and_overlong_numbers():
    assert C.read_uleb128(b"") is None and C.read_uleb128(b"\x80") is None and C.read_uleb128(b"\x80" * 11) is None


@given(st.lists(st.none() | st.integers(0, 5)))
def test_rle_round_trip(xs):
    assert C.rle_decode(C.rle_encode(xs, "uint"), "uint") == xs


@given(st.lists(st.none() | ints))
def test_delta_round_trip(xs):
    assert C.delta_decode(C.delta_encode(xs)) == xs


@given(st.lists(st.booleans()))
def test_bool_round_trip(xs):
    assert C.bool_decode(C.bool_encode(xs)) == xs


@given(st.binary(max_size=2000))
def test_deflate_round_trip(b):
    assert C.inflate(C.deflate(b)) == b


@given(st.binary(max_size=200))
def test_chunk_round_trip_and_damage(b):
    data = C.write_chunk(C.CHUNK_DOCUMENT, b)
    assert C.read_chunk(data) == (C.CHUNK_DOCUMENT, b)
    with pytest.raises(C.FormatError):
        C.read_chunk(data[:-1] + bytes([data[-1] ^ 1]))


@given(st.binary(max_size=300))
def test_any_bytes_are_read_or_refused(b):
    for data in (b, C.write_chunk(C.CHUNK_DOCUMENT, b)):
        try:
            C.decode_document(data)
        except C.FormatError:
            pass


A, B = "0" * 31 + "1", "0" * 31 + "2"
VALUES = [("null", None), ("bool", True), ("bool", False), ("int", -5), ("uint", (1 << 64) - 1), ("double", 1.5), ("counter", 7), ("timestamp", -9),
          ("str", "hé"), ("bytes", b"\x00\xff")]


def op(n, **more):
    return {"op": (n, A), "obj": None, "key_str": "k", "key_idx": None, "action": "put", "value": ("null", None), "pred": [], "after": None} | more


def test_document_round_trip():
    ops = [op(k + 1, key_str=f"k{k}", value=v) for k, v in enumerate(VALUES)]
    n = len(ops)
    ops += [op(n + 1, action="make_object", value=("obj", "list")), op(n + 2, obj=(n + 1, A), key_str=None, key_idx=0, action="insert", value=("int", 3)),
            op(n + 3, obj=(n + 1, A), key_str=None, key_idx=0, action="splice_text", value=("str", "x" * 400), after=(n + 2, A)),
            op(n + 4, action="del", pred=[(1, A), (2, B)]), op(n + 5, action="increment", value=("counter", 2), pred=[(1, A)]),
            op(n + 6, action="mark", key_str="bold", value=("bool", True), pred=[(n + 2, A), (n + 3, A)])]
    c = {"actor": A, "seq": 1, "start_op": 1, "ts_ms": -3, "message": "m", "deps": ["ab" * 32], "ops": ops}
    d = C.decode_document(C.encode_document([c], ["cd" * 32], A, n + 7, 1))
    assert d["heads"] == ["cd" * 32] and d["clock"] == {A: 1} and d["next_counter"] == n + 7 and d["actor"] == A
    assert d["changes"] == [c]
