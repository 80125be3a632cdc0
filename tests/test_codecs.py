import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import codecs, crypto


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=600))
def test_round_trips(data):
    for name in ("ans12", "ans14", "huffman", "rle", "zstd"):
        encode, decode = codecs.CODECS[name]
        assert decode(encode(data)) == data
    name, packed = codecs.smallest(data)
    assert codecs.CODECS[name][1](packed) == data


@pytest.mark.parametrize("bits", range(1, 9))
def test_bits(bits):
    values = np.arange(100) % (1 << bits)
    assert (codecs.unpack_bits(codecs.pack_bits(values, bits), bits, 100) == values).all()


def test_limits():
    with pytest.raises(ValueError):
        codecs.pack_bits(np.array([16]), 4)
    assert codecs.pack_bits(np.array([17]), 4, mask=True) == b"\x01"
    for bits in (0, 9):
        with pytest.raises(ValueError):
            codecs.check_bits(bits)
    assert codecs.rle_encode(b"a" * 256) == b"\xffa\x01a" and codecs.rle_encode(b"") == b""
    with pytest.raises(ValueError):
        codecs.rle_decode(b"abc")
    assert codecs.CodecConfig.from_env({"COMP_BITS": "x", "COMP_LEVEL": "5"}).level == 5
    with pytest.raises(ValueError):
        codecs.CodecConfig.from_env({"COMP_CODEC": "nope"})
    assert codecs.zstd_decode(codecs.zstd_encode(b"a" * 100_000)) == b"a" * 100_000


def test_sql_packing(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([16],), ([],)], "v array<int>")
    assert [r[0] for r in rows.select(codecs.pack_bits_sql(F.col("v"), 4)).collect()] == [b"\x21\x03", None, b""]


def test_chacha_vectors():
    key, nonce, aad = bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647"), bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    plain = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    sealed = crypto.chacha_seal(plain, key, nonce, aad)
    assert sealed[-16:].hex() == "1ae10b594f09e26a7e902ecbd0600691"
    assert crypto.chacha_open(sealed, key, nonce, aad) == plain
    assert crypto.chacha_open(sealed[:-1] + b"\x00", key, nonce, aad) is None and crypto.chacha_open(b"x", key, nonce) is None
    assert crypto.chacha_open(crypto.chacha_seal(b"", key, nonce), key, nonce) == b""


def test_hkdf():
    assert crypto.hkdf(b"\x0b" * 22, b"", 42).hex() == "8da4e775a563c18f715f802a063c5a31b8a11f5c5ee1879ec3454e5f3c738d2d9d201395faa4b61a96c8"
    assert crypto.hkdf(b"k" * 32, b"ctx1") != crypto.hkdf(b"k" * 32, b"ctx2")
    assert len(crypto.hkdf(b"k", b"", 8160)) == 8160
    with pytest.raises(ValueError):
        crypto.hkdf(b"k", b"", 8161)


def test_aes(spark):
    key = bytes(32)
    rows = spark.createDataFrame([(1, b"hello"), (2, b""), (3, None)], "id long, p binary").withColumn("n", crypto.counter_nonce(F.col("id"))).withColumn("s", crypto.aes_seal(F.col("p"), key, F.col("n")))
    got = [tuple(r) for r in rows.select(crypto.aes_open(F.col("s"), key, F.col("n")), F.length("s"), crypto.aes_open(F.col("s"), b"1" * 32, F.col("n"))).collect()]
    assert got == [(b"hello", 21, None), (b"", 16, None), (None, None, None)]
