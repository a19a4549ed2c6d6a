"""Substrings, decontamination, fingerprints, packing, chat, licences: exact results on small and awkward tables."""

import array
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat, decontaminate, fingerprints, licenses, packing, registry, substrings
from tidemark.llm import textkit as K

DOCS = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(60)]
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id"), (5, "wörter 日本 " * 40), (6, " ".join(WORDS)), (7, "x " + " ".join(WORDS[5:40]) + " y"), (6, " ".join(WORDS)), (8, "a" * 200_000), (None, None)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF), duck, registry.ORACLE_SQL[name])


@given(st.lists(st.text(alphabet=st.sampled_from("aB\t \n\x0b\x00\x1fé日."), max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    for table, pattern, lower in ((K.SPACED, rb"[^\x20\x09-\x0D]+", False), (K.ALNUM_LOWER, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        w = K.words_of(pa.array(texts, pa.string()), table)
        raw = w.data.tobytes()
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw) if lower else raw
        for i, t in enumerate(texts):
            t = t.encode()
            t = bytes(b + 32 if 65 <= b <= 90 else b for b in t) if lower else t
            a, b = w.first[i], w.first[i + 1]
            assert [raw[x:y] for x, y in zip(w.starts[a:b], w.ends[a:b], strict=True)] == re.findall(pattern, t)


def kept_words(rows, n=13):
    docs = [(float("inf") if i is None else i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in docs:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in docs:
        gone = {p for k in range(len(w) - n + 1) if least[tuple(w[k : k + n])] < i for p in range(k, k + n)}
        out.append((b" ".join(x for p, x in enumerate(w) if p not in gone).decode(), len(w), len(gone)))
    return out


def test_substrings_brute_force(spark, awkward):
    rng = np.random.default_rng(3)
    rows = list(AWKWARD)
    for i in range(10, 60):
        parts = [" ".join(rng.choice(WORDS, 30)) for _ in range(3)]
        if i > 12:
            source = rows[int(rng.integers(12, len(rows)))][1].split()
            k, size = int(rng.integers(0, 40)), int(rng.integers(10, 30))
            parts.insert(1, " ".join(source[k : k + size]))
        rows.append((i, " ".join(parts)))
    got = substrings.repeated_words(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r._td_kept, r._td_words, r._td_removed) for r in got) == sorted(kept_words(rows))


def test_substrings_edges(spark, empty):
    assert substrings.repeated_words(empty).count() == 0
    clash = spark.createDataFrame([(1, " ".join(WORDS), "e", 5), (2, " ".join(WORDS), "e", 6)], "doc_id long, text string, runs string, share long")
    out = {r.doc_id: r for r in substrings.dedup_substrings(clash).collect()}
    assert out[1].text == " ".join(WORDS) and out[2].text == "" and out[2].share == 6
    with pytest.raises(ValueError):
        substrings.repeated_words(clash, window=12, block=7)


def contaminated(docs, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            if item is None or not b:
                continue
            m = min(10, len(b))
            grams = {tuple(b[k : k + m]) for k in range(len(b) - m + 1)}
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in grams:
                    hit |= set(range(k, k + m))
                    found.add(item)
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_decontamination_brute_force(spark, block_words):
    items = [(1, " ".join(WORDS[:25])), (2, "W7, w8. w9"), (3, ""), (4, None), (None, "w1 w2"), (5, " ".join(WORDS[30:41])), (5, " ".join(WORDS[30:41])), (6, "one"), (7, " ".join(WORDS[7:17]))]
    docs = [*AWKWARD, (9, " ".join(WORDS[3:13]) + " zz " + " ".join(WORDS[3:12])), (10, "w7 W8-w9 one")]
    got = decontaminate.contaminated_words(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), block_words).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=key) == sorted(contaminated(docs, items), key=key)
    assert all(sum(s.length for s in r.spans) == r.n_hit for r in got)


def test_decontamination_edges(spark, awkward, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated_words(awkward, none).where("n_hit > 0").count() == 0
    assert decontaminate.contaminated_words(empty, none).count() == 0
    extra = spark.createDataFrame([(1, "w1 w2 w3", "x"), (2, "other", None)], "doc_id long, text string, items string")
    kept = decontaminate.drop_contaminated(extra, spark.createDataFrame([(1, "w2")], "item_id long, text string")).collect()
    assert [tuple(r) for r in kept] == [(2, "other", None)]


def test_fingerprints(spark, awkward, empty):
    rows = fingerprints.merkle_fingerprints(awkward).collect()
    texts = {}
    for (i, t), _ in zip(AWKWARD, range(len(AWKWARD)), strict=True):
        texts.setdefault(i, []).append(t or "")
    assert len(rows) == len(AWKWARD)
    by_text = {}
    for r in rows:
        text = [t for t in texts[r.doc_id] if len(t) == r.n_chars][0]
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert sum(fingerprints.parse(r.fingerprint)[1]) == len(text.encode())
    assert len(set(by_text.values())) == len(by_text)
    assert fingerprints.merkle_fingerprints(empty).count() == 0
    alone = fingerprints.merkle_fingerprints(spark.createDataFrame([(1, "abcdefgh")], DOCS)).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and alone.near_next == 1.0


def test_edits_are_located():
    before, after = ["first line here.\n", "second line here.\n", "third line here.\n"] * 10, None
    after = [*before]
    after[4] = "changed line here.\n"
    tree = fingerprints.Tree(["".join(before).encode(), "".join(after).encode()])
    spans = fingerprints.edits(tree.fingerprint(0), tree.fingerprint(1))
    text = "".join(after).encode()
    assert any(b"changed" in text[a:b] for a, b in spans) and sum(b - a for a, b in spans) < len(text) / 2
    assert fingerprints.edits(tree.fingerprint(0), tree.fingerprint(0)) == []


def edited_text(t, following):
    k = len(t) // 4
    return t[: len(t) - k] + (following[:k] if k else "")


def test_fingerprints_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), " ".join(rng.choice(WORDS, int(rng.integers(0, 60)))) + "é.\n" * int(rng.integers(0, 3))) for i in rng.permutation(90)] + [(200, None), (201, ""), (202, "日本語" * 50)]
    extra = spark.createDataFrame([(*r, "clash", 5) for r in rows], DOCS + ", fingerprint string, bucket int").repartition(7)
    got = {r.doc_id: r for r in fingerprints.merkle_fingerprints(extra).collect()}
    order = sorted((i, t or "") for i, t in rows)
    prints = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        other = edited_text(t, following)
        tree = fingerprints.Tree([t.encode(), other.encode(), following.encode()])
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (tree.fingerprint(0), tree.fingerprint(1))

        def shared(a, b):
            bags = []
            for text in (a, b):
                h, n = fingerprints.parse(fingerprints.Tree([text.encode()]).fingerprint(0))
                bag = {}
                for x, size in zip(h.tolist(), n.tolist(), strict=True):
                    bag.setdefault(x, []).append(size)
                bags.append(bag)
            both = sum(min(len(v), len(bags[1].get(x, []))) * v[0] for x, v in bags[0].items())
            total = len(a.encode()) + len(b.encode())
            return 2 * both / total if total else 1.0

        assert abs(got[i].near_next - shared(t, following)) < 1e-9 and abs(got[i].near_edited - shared(t, other)) < 1e-9
        assert prints.setdefault(got[i].fingerprint, t) == t


@pytest.mark.parametrize("change", ["replace", "delete", "insert", "move", "none", "repeat"])
def test_every_kind_of_edit_is_located(change):
    lines = [f"line number {i} holds the words {'abcdefgh'[i % 8]} and {i * 7}.\n" for i in range(40)]
    after = list(lines)
    if change == "replace":
        after[11] = "something else stands here now.\n"
    elif change == "delete":
        del after[11]
    elif change == "insert":
        after.insert(11, "a new line.\n")
    elif change == "move":
        after.insert(30, after.pop(11))
    elif change == "repeat":
        after.insert(30, after[11])  # a leaf that also occurs elsewhere
    tree = fingerprints.Tree(["".join(lines).encode(), "".join(after).encode()])
    spans = fingerprints.edits(tree.fingerprint(0), tree.fingerprint(1))
    place = len("".join(after[:11]).encode())
    if change == "none":
        assert spans == []
    elif change == "delete":
        assert spans and all(a <= place <= b for a, b in spans)
    elif change in ("replace", "insert"):
        assert any(a <= place < b for a, b in spans) and sum(b - a for a, b in spans) < 200
    else:
        moved = len("".join(after[:30]).encode())
        assert any(a <= moved < b for a, b in spans)


def test_packing(spark, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(WORDS, int(rng.integers(1, 900))))) for i in range(40)] + [(100 + i, "tiny text" * (i % 3)) for i in range(150)] + AWKWARD
    rows.append((99, "word and 日本 word\n\n" * 70_000))  # over a megabyte: encoded in parts
    got = packing.pack(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", item string, uid int")).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        at, size, piece = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            want.append((i, piece, at, size, zlib.crc32(array.array("I", ids[at : at + size]).tobytes())))
            at, size, piece = at + size, 1024, piece + 1
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in got) // 1024) * 1.1 + 1
    assert packing.pack(empty).count() == 0


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@given(st.lists(st.tuples(st.integers(1, 9), st.booleans()), max_size=60))
@settings(max_examples=80, deadline=None)
def test_items_take_the_smallest_free_gap(rows):
    rows = sorted(rows, key=lambda r: (-r[0], not r[1]))
    got = dict(zip(*[x.tolist() for x in reversed(packing.matched(np.array([g for _, g in rows], bool)))], strict=True)) if rows else {}
    free, want = [], {}
    for k, (_, gap) in enumerate(rows):
        if gap:
            free.append(k)
        elif free:
            want[k] = free.pop()
    assert got == want


def test_ranges_are_resolved_by_rank():
    gaps, items = packing.resolve([(0, 2, 3), (1, 0, 2), (2, 4, 1), (5, 9, 0)])
    assert gaps == [(1, 0, 0, 2), (0, 0, 2, 2), (2, 0, 4, 1), (0, 2, 5, 1)]
    assert items == [(2, 0, 0, 2), (2, 2, 2, 2), (5, 0, 4, 1), (5, 1, 5, 1)]


@pytest.mark.parametrize("rows, most", [(10**6, 700), (40, 700), (40, 40), (60, 1023)])
def test_supersteps_pack_as_well_as_best_fit_decreasing(spark, monkeypatch, rows, most):
    monkeypatch.setattr(packing, "ROWS", rows)
    rng = np.random.default_rng(most)
    sizes = [int(x) for x in rng.integers(1, most + 1, 300)]
    items = K.checkpointed(spark.createDataFrame(list(enumerate(sizes)), "id long, size long"))
    got = [tuple(r) for r in packing.best_fit(items, 1024).collect()]
    assert sorted(r[0] for r in got) == list(range(300))
    sequences = {}
    for item, sequence, offset in got:
        sequences.setdefault(sequence, []).append((offset, sizes[item]))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 1024
    assert len(sequences) <= best_fit_decreasing(sizes, 1024) * 1.03 + 1


CONV = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be <|kind|> & brief"), *[(1, k, "assistant" if k % 2 == 0 else "user", f"turn {k} " + "word " * (17 * k % 300) + "<|end|>\n&a") for k in range(1, 40)],
            (2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, None, None, None), (None, 1, "user", "x<"), (None, 2, "assistant", "|>y"), (4, 0, "assistant", "long " * 3000)]
    windows = chat.format_conversations(spark.createDataFrame(rows, CONV)).collect()
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, CONV))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert back[c].n_turns == len(own)
        assert back[c].turns == "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        assert back[c].loss_text == "".join(r[3] or "" for r in own if r[2] == "assistant")
    first = [w for w in windows if w.conv_id == 1]
    assert len(first) > 3 and all(w.formatted.startswith("<|system|>") for w in first)
    for w in first:
        tokens = sum(4 + len(re.findall(chat.TOKEN, t)) for t in w.formatted.split("<|end|>\n")[:-1])
        assert tokens <= chat.BUDGET * 1.2
    assert chat.format_conversations(spark.createDataFrame([], CONV)).count() == 0


def test_licences(spark, empty):
    mit = "The MIT License (MIT)\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    docs = spark.createDataFrame([(1, mit), (2, "Prose. Licensed under the Apache License, Version 2.0.\nMore. Released under the MIT License."), (3, None), (4, "See the license.")], DOCS)
    got = {r.doc_id: r for r in licenses.license_scans(docs).collect()}
    assert got[1].identifiers[0] == "mit-name" and got[1].licenses == ["MIT"]
    assert got[2].licenses == ["MIT", "Apache-2.0"]
    assert (got[3].n_sentences, got[3].licenses) == (0, []) and got[4].licenses == []
    assert licenses.license_scans(empty).count() == 0


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n" "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
NOTICES = {
    "gpl": (GPL, ["GPL-3.0-or-later"]), "gpl in hash comments": ("\n".join("# " + x for x in GPL.split("\n")), ["GPL-3.0-or-later"]), "gpl in star comments": ("/*\n" + "\n".join(" * " + x for x in GPL.split("\n")) + "\n */\ncode()", ["GPL-3.0-or-later"]),
    "two in a row": (BSD + BSD, ["BSD-3-Clause"]), "apache in one line": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', ["Apache-2.0"]),
    "commented mit": ("\n".join("// " + x for x in ("Permission is hereby granted, free of charge, to any person obtaining a copy", 'of this software and associated documentation files (the "Software"), to deal', "in the Software without restriction, including without limitation the rights", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell", "copies of the Software, and to permit persons to whom the Software is", "furnished to do so, subject to the following conditions:")), ["MIT"]),
    "a line without a stop": ("my project\nReleased under the MIT License\nand more words", ["MIT"]), "spdx": ("// SPDX-License-Identifier: Apache-2.0\nint x;", ["Apache-2.0"]), "lgpl": (GPL.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"), ["LGPL-2.1-or-later"]),
    "a very long text": ("Some prose here. " * 40_000 + "ISC License\n", ["ISC"]),
}


def test_notices_as_they_are_laid_out(spark, duck):
    rows = [(i, text, "clash", 1) for i, (text, _) in enumerate(NOTICES.values())]
    docs = spark.createDataFrame([*rows, rows[0]], DOCS + ", licenses string, s int")
    got = licenses.license_scans(docs).collect()
    for r in got:
        assert r.licenses == list(NOTICES.values())[r.doc_id][1], list(NOTICES)[r.doc_id]
    assert len(got) == len(rows) + 1
