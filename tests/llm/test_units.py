"""The operators' inner parts against plain versions."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpusmill.llm import bpe, decontaminate, language, ngramjoin, quality, spandedup, tokencount, toxicity
from corpusmill.llm.common import words


def test_bpe_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = bpe.codec(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = ["", " ", "Hello <|endoftext|>World <|ENDOFTEXT|> <|startoftext|>", "ΑΣ ΟΔΟΣ Σ", "İstanbul ﬁ ½", "don't we'll", "a\x85b\x1cc", "🎉👍🏽 가", "x" * 3000]
    texts += ["".join(rng.choices("abcdeéß Ñ.!?'1\n\t🙂", k=200)) for _ in range(50)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert np.frombuffer(got, dtype="<u4").tolist() == want
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_fm_index_finds_what_a_scan_finds():
    rng = random.Random(2)
    items = [(str(k), [bytes(rng.choices(b"abc", k=1)) for _ in range(n)]) for k, n in enumerate((0, 1, 3, 5, 8))]
    phrases = decontaminate.Phrases(items, 4)
    texts = [None, b""] + [b" ".join(bytes(rng.choices(b"abcd", k=1)) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    counts, spans, found = decontaminate.find(phrases, texts)
    for text, count, span, ids in zip(texts, counts, spans, found, strict=True):
        seq, hit, want = words(text), set(), set()
        for item, row in items:
            size = min(4, len(row))
            for k in range(len(row) - size + 1 if row else 0):
                for at in range(len(seq) - size + 1):
                    if seq[at : at + size] == row[k : k + size]:
                        hit |= set(range(at, at + size))
                        want.add(item)
        assert count == len(seq) and ids == want
        assert {p for a, b in span for p in range(a, b)} == hit


def test_hits_are_cut_out():
    assert decontaminate.without(b"One, two three. Four", [(1, 3)]) == b"One, . Four"


def test_segments_are_the_maximal_ones():
    def plain(score):  # by definition: the best segment, then the same on both sides
        best = max(((sum(score[a:b]), -(b - a), a, b) for a in range(len(score)) for b in range(a + 1, len(score) + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        _, _, a, b = best
        return [*plain(score[:a]), (a, b), *[(x + b, y + b) for x, y in plain(score[b:])]]

    rng = random.Random(3)
    for _ in range(60):
        score = [rng.choice((-1.3, -0.7, -2.1, 1.1, 2.3)) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(score))] == plain(score)


def test_segments_take_linear_time():
    import time

    def seconds(n):
        rng = np.random.default_rng(n)
        best = []
        for score in (np.tile([1.0, -2.0], n // 2), np.where(rng.random(n) < 0.5, 1.0, -1.01), np.tile([1.0, -0.999], n // 2)):
            start = time.perf_counter()
            toxicity.segments(score)
            best.append(time.perf_counter() - start)
        return max(best)

    seconds(1000)
    assert seconds(1_000_000) < 60 * seconds(50_000) + 0.5  # twenty times as long; the square would be 400 times


def test_repeated_words_as_by_hand():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 40):
        found = rng.choices("abc", k=n)
        grams = [tuple(found[k : k + 3]) for k in range(n - 2)]
        hit = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 3)}
        assert quality.repeated_words(found)[0] == len(hit)


def test_em_tells_good_from_bad_patterns():
    good, bad = 3 ** len(quality.RULES) - 1, 0
    post = quality.estimate(np.array([good, bad]), np.array([900.0, 100.0]))
    assert post[0] > 0.9 and post[1] < 0.1


def test_trie_counts_equal_a_plain_search(monkeypatch):
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -2.2, "ba": -2.9, "▁ab": -6.0}
    own = tokencount.Counter(pieces)

    def plain(word):
        best = [(0.0, 0)] + [(-1e9, 0)] * len(word)
        for k in range(1, len(word) + 1):
            spelled = len(word[k - 1].encode())
            options = [(best[k - 1][0] + spelled * own.byte_score, -(-best[k - 1][1] + spelled))]
            options += [(best[a][0] + pieces[word[a:k]], best[a][1] - 1) for a in range(k) if word[a:k] in pieces]
            best[k] = max(options)
        return -best[-1][1]

    rng = random.Random(5)
    texts = ["".join(rng.choices("abcé ", k=rng.randint(0, 20))) for _ in range(200)]
    want = [sum(plain("▁" + w) for w in text.split()) for text in texts]
    assert own.texts(texts) == want == own.texts(texts)
    monkeypatch.setattr(tokencount, "TOGETHER", 5)
    monkeypatch.setattr(tokencount, "KNOWN", 20)
    monkeypatch.setattr(tokencount, "LONGEST", 6)
    assert tokencount.Counter(pieces).texts(texts) == want
    assert own.texts([None, "  "]) == [0, 0] and own.texts([]) == []


def test_sentences_are_the_text():
    rng = random.Random(7)
    texts = ["", "One. Two!\n\nThree", "...", "a.b?c  d\n", "\n\n"] + ["".join(rng.choices("ab.!? \n\t\x0b\x85é", k=rng.randint(0, 60))) for _ in range(500)]
    for text in texts:
        before, cut = spandedup.sentences(text)
        assert before + "".join(cut) == text and not before.strip(spandedup.BLANK) and all(s.strip(spandedup.BLANK) for s in cut)
    assert spandedup.sentences("It is 3.14. Or e.g. " + "w " * 20)[1] == ["It is 3.14. ", "Or e.g. ", "w " * 16, "w " * 4]


def test_minhash_estimates_and_pruning_keeps_similar_pairs():
    rng = random.Random(6)
    base = [str(rng.randint(0, 10**6)).encode() for _ in range(400)]
    near = base[:200] + [b"zz"] + base[201:]
    a, b = ngramjoin.shingles(b" ".join(base)), ngramjoin.shingles(b" ".join(near))
    real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    sig = np.stack([ngramjoin.signature(a), ngramjoin.signature(b)])
    assert abs((sig[0] == sig[1]).mean() - real) < 0.1
    few = ngramjoin.fewest_matches(0.8, 1e-6)
    assert all(0 < few[n] < 0.8 * n for n in few)


def test_language_model_separates():
    texts = [("en", "the cat and the dog were in the house with that man"), ("de", "der hund und die katze sind nicht im haus mit dem mann")] * 5
    rows = {lang: np.array([language.counts(t) for own, t in texts if own == lang]) for lang in ("en", "de")}
    idf = np.ones(language.BUCKETS, dtype=np.float32)
    model = language.Model(idf, [(lang, *language.centroids_of(r, idf)) for lang, r in rows.items()])
    top, score, _ = model.predict(np.array([language.counts("the dog in the house"), language.counts("der hund im haus")]))
    assert [model.langs[k] for k in top] == ["en", "de"] and (score > 0).all()
    assert not language.has_letter(None) and not language.has_letter("123 !") and language.has_letter("1é")


def test_settled_passes_all_batches_and_failures_on():
    import pytest

    from corpusmill.llm.common import settled

    assert list(settled(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3]

    def broken(batches):
        yield next(batches)
        raise ValueError("broken")

    with pytest.raises(ValueError, match="broken"):
        list(settled(broken)(iter([1, 2])))
