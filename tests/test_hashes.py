import random

from pyspark.sql import functions as F
from strandline.functions import dna, hashes

M32, M64 = 2**32 - 1, 2**64 - 1


def finalised(x, steps):
    for s, f in steps[0]:
        x = (x ^ x >> s) * f & M64
    return x ^ x >> steps[1]


def six(x):
    x = x + 0x7ED55D16 + (x << 12) & M32
    x = x ^ 0xC761C23C ^ x >> 19
    x = x + 0x165667B1 + (x << 5) & M32
    x = (x + 0xD3A2646C & M32) ^ (x << 9 & M32)
    x = x + 0xFD7046C5 + (x << 3) & M32
    return x ^ 0xB55A4F09 ^ x >> 16


def halved(x):
    x = (~x & M64) + (x << 18 & M64) & M64
    x = (x ^ x >> 31) * 21 & M64
    x ^= x >> 11
    x = x + (x << 6 & M64) & M64
    return (x ^ x >> 22) & M32


def murmur32(x):
    x = (x ^ x >> 16) * 0x85EBCA6B & M32
    x = (x ^ x >> 13) * 0xC2B2AE35 & M32
    return x ^ x >> 16


def test_integer_hashes(spark):
    r = random.Random(1)
    wide = [0, 1, M64, 1 << 63, *(r.getrandbits(64) for _ in range(60))]
    signed = lambda x: x - 2**64 if x >> 63 else x
    v, low = F.col("v"), F.col("v").bitwiseAND(F.lit(M32).cast("long"))
    df = spark.createDataFrame([(signed(x),) for x in wide], "v long").select("v", hashes.murmur64(v), hashes.splitmix64(v), hashes.halved(v), hashes.six_rounds32(low), dna.hash_murmur32(low))
    want = [(signed(x), signed(finalised(x, hashes.MURMUR64)), signed(finalised(x, hashes.SPLITMIX64)), halved(x), six(x & M32), murmur32(x & M32)) for x in wide]
    assert [tuple(row) for row in df.collect()] == want
