import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import edit_counts as E
from sheaf.llm import flac, language_id, license_scan
from sheaf.llm.tokens import splitter, token_ids


def test_languages_of_held_out_texts(small, odd, odd_extended, none):
    learn = small.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    out = {r.doc_id: r for r in language_id.predict_languages(small, learn).collect()}
    held = [r for r in small.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([out[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
    for frame in (odd, odd_extended):
        got = language_id.predict_languages(frame, small).collect()
        assert len(got) == frame.count()
        assert {r.doc_id: r.lang_pred for r in got}[3] == "und" and {r.doc_id: r.lang_pred for r in got}[8] == "und"
        assert all(0 <= r.score <= 1 for r in got)
    assert language_id.predict_languages(none, small).count() == 0
    assert {r.lang_pred for r in language_id.predict_languages(odd, none).collect()} == {"und"}


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def base_places(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    found = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(i for i, _ in found), {label for _, label in found}


def test_license_base_is_exact(small, odd, odd_extended, none, spark):
    tricky = [(1, "cc by cc by CC-BY 4.0"), (2, "General  Public\nLicense? all rights reserved all rights all rights reserved"), (3, "cc cc by by"), (4, "mit License")]
    for frame in (small, odd, odd_extended, spark.createDataFrame(tricky, "doc_id long, text string")):
        texts = {}
        for r in frame.collect():
            texts.setdefault(r.doc_id, []).append(base_places(r.text))
        for r in license_scan.scan(frame).collect():
            n, places, labels = texts[r.doc_id].pop(0) if r.doc_id is not None else (r.n_words, [], set())
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), places[0] if places else None, places[-1] if places else None)
            assert r.base_labels == ",".join(sorted(labels))
            assert labels <= set(filter(None, r.labels.split(",")))
            assert 0 <= r.score <= 1
    assert license_scan.scan(none).count() == 0


def test_license_notices(spark):
    rows = [(1, "word " * 50 + "Released under the MIT License. " + "tail " * 9), (2, "mit der license"), (3, "Licensed under the Apache License, Version 2.0."), (4, "nothing at all")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4)] == ["mit", "", "apache", ""]
    assert got[1].places[0].start == 50 and got[1].score == 1.0


STANDARD = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),'
    " to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute",
    "apache": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "bsd": "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
    " the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
VARIANTS = (
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("gpl", "under the GNU General Public License, version 2, as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction"),
    ("apache", "Apache License 2.0"),
    ("", "Software without restriction. Permission is hereby granted"),
    ("", "Permission is hereby granted. " + "word " * 60 + "software without restriction"),
    ("", "with or without fee is hereby granted permission to use copy modify"),
)


def test_standard_notices_and_variants(spark):
    texts = [*STANDARD.items(), *VARIANTS]
    rows = [(i, f"{'some words ' * (i % 3)}{text}") for i, (_, text) in enumerate(texts)]
    out = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].labels for i in range(len(texts))] == [label for label, _ in texts]
    assert all(out[i].score == 1.0 for i in range(len(STANDARD)))
    assert all(p.start >= 0 for r in out.values() for p in r.places)


def test_a_language_of_copies_keeps_its_centroid(spark):
    english = [(i, f"the cat number {i} sat on the mat and looked at {i % 7} birds over there", "en") for i in range(300)]
    german = [(1000 + i, "der kleine Hund lief über die Straße und schlief später unter dem Baum", "de") for i in range(5000)]
    df = spark.createDataFrame(english + german, "doc_id long, text string, lang string").repartition(4)
    model = language_id.CentroidModel(df)
    assert set(model.langs) == {"de", "en"}
    assert model.predict("der Hund schlief unter der Straße")[0] == "de" and model.predict("the birds sat there")[0] == "en"


def naive_places(template, words):
    """Starts of a template by trying every choice of phrase places."""
    def occurrences(own):
        return [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]

    out = []
    for first in occurrences(template.phrases[0][1]):
        reached = {first}
        for (before, last), (at, own) in zip(template.phrases, template.phrases[1:], strict=False):
            gap = at - before
            reached = {j for i in reached for j in occurrences(own) if gap - license_scan.WINDOW <= j - i <= gap + license_scan.WINDOW and j - i >= min(len(last), gap)}
        if reached:
            out.append(max(first - template.phrases[0][0], 0))
    return out


def test_licence_labels_against_brute_force(spark, small):
    rng = random.Random(11)
    templates = license_scan.default_templates()
    notices = [" ".join(w.decode() for w in t.words) for t in templates]
    texts = [r.text for r in small.collect()]
    for _ in range(80):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(notices).split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = ["x"] * rng.randrange(3)
            parts.append(" ".join(words))
        texts.append(" some other words ".join(parts))
    rows = list(enumerate(texts))
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = license_scan.words_of(texts[r.doc_id])
        want = sorted((t.label, start) for t in templates for start in naive_places(t, words))
        assert sorted((p.label, p.start) for p in r.places) == want
        assert r.labels == ",".join(sorted({label for label, _ in want}))


def test_licence_versions(spark):
    texts = ["GNU General Public License, version 3 or later", "GNU General Public License v2", "the Apache License, Version 2.0", "GNU Lesser General Public License 2.1", "Mozilla Public License", "CC BY-SA 4.0"]
    out = {r.doc_id: defaultdict(lambda: None, {p.label: p.version for p in r.places if p.version}) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[0]["gpl"], out[1]["gpl"], out[2]["apache"], out[3]["lgpl"], out[4]["mpl"], out[5]["cc-by-sa"]] == ["3", "2", "2.0", "2.1", None, "4.0"]


def test_flac_round_trip(odd, odd_extended, none, small):
    for frame in (odd, odd_extended, small):
        want = {}
        for r in frame.collect():
            data, n = flac.payload(r.text)
            want.setdefault(r.doc_id, set()).add((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:])))
        for r in flac.digests(frame).collect():
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id]
        blocks = flac.pcm_blocks(flac.encode(frame).filter("doc_id = 1")).orderBy("block").collect()
        text = next((r.text for r in frame.collect() if r.doc_id == 1), None)
        assert b"".join(bytes(b.pcm) for b in blocks) == flac.payload(text)[0]
        assert [b.sample_offset for b in blocks] == [192 * i for i in range(len(blocks))]
    assert flac.digests(none).count() == 0


def test_flac_signals_and_damage():
    rng = random.Random(4)
    waves = [bytes(rng.randrange(256) for _ in range(1920)), bytes([0, 255] * 960), bytes(192), bytes([128] * 191 + [255]),
             bytes(int(128 + 100 * np.sin(i / 9)) for i in range(19200)), bytes([0] * 190 + [255, 0])]
    streams = flac.encode_all(waves)
    assert flac.decode_all(streams) == waves
    assert len(streams[4]) < len(waves[4]) / 2  # a tone is predicted well
    for stream in (streams[0], streams[4]):
        for at in (len(stream) - 1, len(stream) // 2, len(stream) - 40):
            damaged = bytearray(stream)
            damaged[at] ^= 4
            with pytest.raises(flac.FlacError):
                flac.decode_all([bytes(damaged)])


def test_edits_equal_encoding_from_scratch():
    rng = random.Random(6)
    pieces = ["<|endoftext|>", "<|endoftext", "|>", ">", "a", "b", " ", "  ", "\n", "'s", "'", "1", "é", "!", "the ", "\t", " x", "ll", "re'", "   ", "中"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(60)))
        tree = E.SegmentTree(text, rng.choice([1, 2, 3, 8]))
        for _ in range(rng.randrange(1, 5)):
            start = rng.randrange(len(text) + 3)
            end = start + rng.randrange(10)
            new = "".join(rng.choice(pieces) for _ in range(rng.randrange(4)))
            tree.edit(start, end, new)
            end = min(end, len(text))
            start = min(start, end)
            text = text[:start] + new + text[end:]
            assert tree.text() == text and tree.n_chars == len(text)
            assert tree.n_tokens == len(token_ids(text)) and tree.pieces() == splitter().findall(text)
            assert max(len(own) for own, _ in tree.leaves) <= 2 * tree.leaf


@functools.lru_cache
def whole_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    """By the vocabulary's tokenizers file."""
    return whole_tokenizer().encode(text, add_special_tokens=False).ids


def test_large_and_repeated_inserts():
    text = " \n" * 300_000 + "word " * 2000
    tree, rng = E.SegmentTree(text), random.Random(8)
    assert tree.n_tokens == len(ids_of(text))
    before = tree.n_tokens
    for k in range(40):
        start = rng.randrange(600_000, len(text))
        new = "some new words " * rng.randrange(200)
        tree.edit(start, start + 3, new)
        text = text[:start] + new + text[start + 3 :]
    assert tree.text() == text and tree.n_tokens == len(ids_of(text)) != before
    assert max(len(own) for own, _ in tree.leaves) <= 2 * E.LEAF


def test_trees_are_kept(spark, small):
    """Edits in two rounds, the second on the trees that the first has kept."""
    rows = [(r.doc_id, r.text, [(3, 9, "new words")]) for r in small.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, todo array<struct<start:int,end:int,new:string>>")
    once = E.follow(E.build(df, "todo"), keep=True)
    again = once.select("doc_id", "text", "lengths", "counts", F.expr("array(named_struct('start', 0, 'end', 1, 'new', 'A b'))").alias("edits"))
    got = {r.doc_id: (r.tokens_before, r.tokens_after, r.text_sha256) for r in E.follow(again).collect()}
    for key, text, _ in rows:
        text = (text or "")[:3] + "new words" + (text or "")[9:]
        after = "A b" + text[1:]
        assert got[key] == (len(ids_of(text)), len(ids_of(after)), hashlib.sha256(after.encode()).hexdigest())


def test_recount_against_brute_force(small, odd, odd_extended, none):
    for frame in (small, odd, odd_extended):
        want = []
        for r in frame.collect():
            text = r.text or ""
            before = len(ids_of(text))
            for start, end, new in E.planned_edits(r.text):
                end = min(end, len(text))
                start = min(start, end)
                text = text[:start] + new + text[end:]
            want.append((r.doc_id, before, len(ids_of(text)), len(text), hashlib.sha256(text.encode()).hexdigest()))
        got = [(r.doc_id, r.tokens_before, r.tokens_after, r.chars_after, r.text_sha256) for r in E.recount(frame).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert E.recount(none).count() == 0


def test_given_edits(spark):
    rows = [(1, "one two three", [(4, 7, "2"), (0, 0, "x")]), (2, None, [(5, 9, "new")]), (3, "abc", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, todo array<struct<start:int,end:int,new:string>>")
    got = {r.doc_id: r for r in E.recount(df, "todo").collect()}
    assert got[1].text_sha256 == hashlib.sha256(b"xone 2 three").hexdigest()
    assert got[2].text_sha256 == hashlib.sha256(b"new").hexdigest() and got[3].n_edits == 0
