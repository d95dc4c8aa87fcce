"""The language model's training and scoring against plain loops."""

import math

import numpy as np
import pyarrow as pa

from tiergraph.llm import mixing
from tiergraph.llm.textops import LOWER, slices


def test_weights_see_every_block(spark, monkeypatch):
    """The mixer's decisions grow with the text of a task, however many blocks it has."""
    monkeypatch.setattr(mixing, "BLOCK_BYTES", 1 << 12)
    monkeypatch.setattr(mixing, "FIRST_BYTES", 1 << 12)
    seen = []
    for copies in (100, 400):
        docs = spark.createDataFrame([(" ".join(f"w{k}" for k in range(200)),)] * copies, "text string").coalesce(1)
        lexicon = mixing.build_lexicon(mixing.count_words(docs), docs)
        seen.append(mixing.train(docs, lexicon)[1].seen.sum() / copies)
    assert np.isclose(*seen, rtol=0.05)


class Plain:
    """A scorer that takes one decision at a time."""

    def __init__(self, lexicon, table, mixer):
        self.lexicon, self.table, self.mixer = lexicon, table, mixer

    def slot(self, mark, context, share):
        begin, many = share
        mixed = (int(mark) ^ int(context)) * int(mixing._SLOT) % 2**64 >> 32
        return (mixed * (many << (self.lexicon.bits - 4)) >> 32) + (begin << (self.lexicon.bits - 4))

    def path(self, tree, symbol, contexts, shares, gate, depths):
        out = 0.0
        for k in range(int(tree.size[symbol])):
            at = int(tree.first[symbol]) + k
            own = gate + min(k, depths - 1)
            stretch = float(self.mixer.weights[own, mixing.INPUTS])
            for j, (c, share) in enumerate(zip(contexts, shares, strict=True)):
                stretch += float(self.mixer.weights[own, j]) * int(self.table[self.slot(tree.mark[at], c, share)]) / mixing.FINE
            stretch = min(12.0, max(-12.0, stretch))
            p = 1 / (1 + math.exp(-stretch))
            cell = int((min(8.0, max(-8.0, stretch)) + 8) * (mixing.BUCKETS - 1) / 16 + 0.5)
            p = 0.5 * p + 0.5 * (self.mixer.map_ones[own, cell] + 16 * p) / (self.mixer.map_all[own, cell] + 16)
            out += math.log10(p if tree.bit[at] else 1 - p)
        return out

    def score(self, text):
        """The log10 probability of a lower-case text."""
        x, mix = self.lexicon, lambda v: int(mixing.mix64(np.array([v % 2**64], dtype=np.uint64))[0])
        (t,) = slices(pa.array([text]), LOWER)
        codes = mixing.find_words(t, mixing.SPACED).code.tolist()
        known = {int(c): int(s) for c, s in zip(x.codes, x.symbol, strict=True)}
        votes, before, out = [0] * mixing.REGISTERS, int(mixing._END), 0.0
        for word, code in [*zip(text.split(), codes, strict=True), (None, int(mixing._END))]:
            register = votes.index(max(votes)) + 1 if max(votes) else 0
            symbol = x.escape + 1 if word is None else min(known.get(code, x.escape), x.escape)
            previous = mix(before) if before in known or before == int(mixing._END) else mix(register + (2 << 32))
            out += self.path(x.words, symbol, [mix(register + (1 << 32)), previous], mixing.WORD_SHARES, 0, mixing.WORD_DEPTHS) + float(x.words.tail[symbol])
            if word is not None and symbol == x.escape:
                letters = word.encode() + b" "
                for i, b in enumerate(letters):
                    back = [letters[i - k] if i >= k else 0x20 for k in range(1, 6)]
                    contexts = [mix((sum(c << 8 * j for j, c in enumerate(back[:k])) | register << 40) + (k << 48)) for k in (2, 3, 4, 5)]
                    out += self.path(x.letters, back[0] * 256 + b, contexts, mixing.LETTER_SHARES, mixing.WORD_DEPTHS + mixing.LETTER_DEPTHS * min(i, mixing.PLACES - 1), mixing.LETTER_DEPTHS)
            if symbol < len(x.register):
                votes[x.register[symbol]] += 1
            before = code
        return out


def test_scores_are_those_of_plain_loops(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_SHARE", 1 / 500)
    texts = [t.lower() for (t,) in docs.select("text").limit(60).collect() if t]
    learned = spark.createDataFrame([(t,) for t in texts[:40]], "text string")
    lexicon = mixing.build_lexicon(mixing.count_words(learned), learned)
    model = (lexicon, *mixing.train(learned, lexicon))
    assert 0 < lexicon.escape < len(lexicon.codes)
    short = [" ".join(t.split()[:40]) for t in texts[35:50]]
    want = [Plain(*model).score(t) for t in short]
    scorer = mixing.Scorer(*model)
    for _ in range(2):  # the second time from what the scorer keeps
        got = np.concatenate([scorer.score(t)[1] for t in slices(pa.array(short), LOWER)])
        assert np.allclose(got, want, rtol=1e-4)


def test_codes_are_distributions():
    """The chances of all symbols after one context add up to one."""
    rng = np.random.default_rng(3)
    mixer = mixing.Mixer()
    mixer.weights = rng.normal(0, 0.5, mixer.weights.shape)
    mixer.map_all = rng.integers(0, 50, mixer.map_all.shape).astype(float)
    mixer.map_ones = mixer.map_all * rng.random(mixer.map_all.shape)
    table = rng.integers(-100, 100, 1 << 18).astype(np.int8)
    for weights, share in (([5], 0.0), ([9, 1], 0.0), (rng.integers(1, 1000, 300), 0.0), (rng.integers(1, 1000, 300), 1 / 32)):
        tree = mixing.code_tree(np.array(weights), share)
        lexicon = mixing.Lexicon(np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0, dtype=np.int64), tree, tree, 0, 0, 0, 0)
        plain = Plain(lexicon, table, mixer)
        total = sum(10 ** (plain.path(tree, s, [12345, 6789], mixing.WORD_SHARES, 0, mixing.WORD_DEPTHS) + float(tree.tail[s])) for s in range(len(weights)))
        assert abs(total - 1) < 1e-9


def test_registers():
    shared = np.kron(np.eye(3), np.ones((4, 4))) * 100 + 1
    groups = mixing.cluster(shared, 8)
    assert len(set(groups.tolist())) == 3 and all(len(set(groups[4 * k : 4 * k + 4].tolist())) == 1 for k in range(3))
    symbol, text = np.array([0, 9, 4, 4, 9, 0, 9]), np.array([0, 0, 0, 0, 0, 1, 1])
    assert mixing.registers_of(symbol, text, groups).tolist() == [0, 1, 1, 1, 2, 0, 1]


def test_every_repeated_word_is_a_context(spark, monkeypatch):
    """Words beyond those with a broadcast count have contexts of their own, and scores do not depend on KNOWN."""
    rng = np.random.default_rng(8)
    often = [k for k in range(400) for _ in range(2 + 600 // (k + 1))]
    texts = [" ".join(f"w{k}" for k in rng.permutation(often)[:300]) for _ in range(20)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    monkeypatch.setattr(mixing, "LEAST_SHARE", 1 / 40)
    (t,) = slices(pa.array([" ".join(f"w{k}" for k in range(400))]), LOWER)
    counts, models, scores = mixing.count_words(docs), [], []
    for known in (1 << 17, 60):
        monkeypatch.setattr(mixing, "KNOWN", known)
        models.append(mixing.build_lexicon(counts, docs))
        scores.append(mixing.Scorer(models[-1], *mixing.train(docs, models[-1])).score(t)[1])
    assert len(models[0].codes) > 200 and not len(models[0].told) and len(models[1].codes) == 60
    codes = mixing.find_words(t, mixing.SPACED).code
    twice = np.isin(codes, models[0].codes)
    before, own = np.append(False, twice), mixing.read_tokens(t, models[1]).contexts[1]
    assert (own[before] == mixing.mix64(codes[twice])).all()
    # Words seen once or never are one, but for what the bitmap takes for others.
    assert models[1].own_context(np.arange(1, 20001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).mean() < 0.03
    assert np.allclose(*scores, rtol=1e-3)
