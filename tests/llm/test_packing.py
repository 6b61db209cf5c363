import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessella.llm import packing
from tests.llm.common import docs, empty, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for capacity in (1, 7, 64, 1024):
        for n in (0, 1, 40, 400):
            lengths = [rng.randint(1, capacity if rng.random() < 0.5 else max(1, capacity // 6)) for _ in range(n)]
            held = defaultdict(list)
            for length, lo, hi, first, each, base in packing.plan(Counter(lengths), capacity):
                for k in range(hi - lo):
                    held[first + k // each].append((base + k % each * length, length))
            for spots in held.values():
                at = 0
                for offset, length in sorted(spots):
                    assert offset == at
                    at += length
                assert at <= capacity
            assert sorted(capacity - sum(n for _, n in s) for s in held.values()) == brute(lengths, capacity)


def test_fast_ids_equal_the_tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    texts = [r[1] or "" for r in rows()] + ["it's  we'll\n\n x\t\ty  ", "a b\u0085c\x1cd", "<|endoftext|>", "日本語 123 ١٢٣", "éÉ ß ſ Ǆ", "'s 't 12ab  ", "​ x"]
    for text in texts:
        assert packing.encode(text, PATH) == t.encode(text, add_special_tokens=False).ids


def test_documents(spark):
    got = packing.pack_documents(docs(spark), PATH).collect()
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = Counter()
    for r in rows():
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(head, len(ids), 1024), len(ids)]
        import zlib

        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r[0], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for spots in held.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(1024 - sum(n for _, n in s) for s in held.values()) == brute([r.length for r in got], 1024)
    assert packing.pack_documents(empty(spark), PATH).count() == 0
