import collections
import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from terralake.llm import alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _sides():
    """Ids and bytes of each side by the libraries that the vocabulary files belong to."""
    whole = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}

    def left(text):
        ids = whole.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(letters[c] for c in whole.id_to_token(i))) for i in ids]

    def right(text):
        ids = model.encode(text)
        piece = model.id_to_piece
        return [(i, bytes([int(piece(i)[3:5], 16)]) if model.is_byte(i) else piece(i).replace("▁", " ").encode()) for i in ids]

    return left, right


def _plain(docs):
    """Every token of one side against every token of the other."""
    left, right = _sides()
    found, counts = [], collections.Counter()
    for id_, text in docs:
        a, b = (left(text), right(text)) if text else ([], [])
        whole = b" " + (text or "").encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a = b = []
        spans = []
        for side in (a, b):
            ends = np.cumsum([0] + [len(x) for _, x in side]).tolist()
            spans.append([(i, s, e) for (i, _), s, e in zip(side, ends, ends[1:])])
        ends_b = {e for *_, e in spans[1]}
        links, low = [], 0
        for i, s, e in spans[0]:
            while low < len(spans[1]) and spans[1][low][2] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        cuts = [e for *_, e in spans[0] if e in ends_b]
        groups = []
        for s, e in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for i, x, y in side if s <= x and y <= e) for side in spans) if len(text) < 20_000 else None)
        counts.update(links)
        found.append((id_, len(a), len(b), groups, links))
    best = collections.defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    rows = []
    for id_, na, nb, groups, links in found:
        digest = "" if not groups else None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()
        rows.append((id_, na, nb, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return rows


def _same(spark, docs, found):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=lambda r: (r[0] is None, r))
    want = sorted(_plain(docs), key=lambda r: (r[0] is None, r))
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(g[7] == w[7] for g, w in zip(got, want) if w[7] is not None)


def test_whole_table_equals_all_pairs_of_tokens(spark, documents, texts):
    _same(spark, texts.items(), alignment.align_tokenizers(documents))


ODD = ["plain words", "", None, "  two  spaces \n\n and\ttabs ", "<|endoftext|> <s> </s> <unk> [INST]", "▁ piece sign ▁", "naïve 漢字 🙂🙂 ﬁ ½ \x00 nul \x7f", "a", " ", "\n", "é" * 50, "word " * 3000, "x" * 3000, "plain words", "١٢٣ ½ ok\r\nok don't we'll"]


def test_odd_texts_and_clashing_columns(spark, odd, monkeypatch):
    from llm_helpers import TEXTS

    _same(spark, TEXTS, alignment.align_tokenizers(odd))
    rows = list(enumerate(ODD))
    df = spark.createDataFrame([(i, t, "c", "c", "c", "c") for i, t in rows], "doc_id long, text string, block string, run string, id string, n_a string")
    _same(spark, rows, alignment.align_tokenizers(df))
    assert alignment.align_tokenizers(df.limit(0)).count() == 0


def test_text_in_pieces_many_runs_and_split_ranges(texts):
    read = lambda name: open(public_tokenizers.path(name), "rb").read()
    v = alignment.Vocabularies.load(read("byte_bpe_50k.tiktoken"), read("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    assert v.cuttable
    long = " ".join(t for t in list(texts.values())[:40] if t)
    whole = v.encoded(long)
    assert len(whole) == 1
    before = alignment.PIECE_CHARS
    try:
        alignment.PIECE_CHARS = 700
        pieces = v.encoded(long)
    finally:
        alignment.PIECE_CHARS = before
    assert len(pieces) > 20
    for side in (0, 1):
        assert np.concatenate([p[side] for p in pieces]).tolist() == whole[0][side].tolist()


def test_merge_of_runs():
    rng = np.random.default_rng(3)
    before = alignment.FRAME
    alignment.FRAME = 50
    try:
        made, all_pairs, all_times = [], [], []
        for _ in range(7):
            # One pair fills whole frames of every run.
            pairs = np.sort(np.where(rng.random(400) < 0.4, 77, rng.integers(0, 300, 400)))
            docs, times = rng.integers(0, 9, 400), rng.integers(1, 5, 400)
            made.append(alignment.packed(pairs, docs, times))
            all_pairs.append(pairs)
            all_times.append(times)
        parts = list(alignment.merged([alignment.Run(m, 0) for m in made]))
    finally:
        alignment.FRAME = before
    assert len(parts) > 20
    flat = [np.concatenate([p for _, p, _, _ in part]) for part in parts]
    assert all(a.max() <= b.min() for a, b in zip(flat, flat[1:]))
    counted = np.bincount(np.concatenate(all_pairs), weights=np.concatenate(all_times), minlength=300)
    merged = np.bincount(np.concatenate(flat), weights=np.concatenate([t for part in parts for *_, t in part]), minlength=300)
    assert counted.tolist() == merged.tolist()


def test_blocks_and_parts_of_any_size_give_the_same(spark, documents, texts):
    whole = sorted(map(tuple, alignment.align_tokenizers(documents).collect()))
    kept = alignment.MERGED_RECORDS
    try:
        alignment.MERGED_RECORDS = 500
        assert sorted(map(tuple, alignment.align_tokenizers(documents.repartition(9)).collect())) == whole
    finally:
        alignment.MERGED_RECORDS = kept
