"""Secret scans: three fixed patterns and a linear-chain conditional random field.

The field tags tokens of a line as beginning a secret, inside one, or outside.  Its features are token
shapes, neighbouring words and facts about the whole file; Viterbi decodes the best tag sequence.  It is
trained here, once per process, on SAMPLE_LINES synthetic lines that are made from a fixed seed.

Lines without any candidate token (see _CANDIDATE) and without a cue word hold plain tokens only.  For
those the all-outside sequence is optimal whenever no plain token can gain by another tag, which
`Model.plain_is_outside` proves from the trained weights; such lines are then skipped without decoding.

Spans are in code points, end exclusive.  A secret begins with a begin tag: a tag inside cannot follow one
outside, or start a line.  A span of the field that lies within a pattern's span is dropped, as the pattern
has told of it already; one that reaches beyond it stays beside it, and redaction masks their union.

Defined cases: a null text counts as empty and has no spans; repeated rows get the same spans each; an
empty table gives an empty result; input columns named like the operator's own are replaced; texts and
lines of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tiergraph.llm.tables import map_text, named, others

#: Labelled lines that the field is fitted on (its bound), the seed they are made from, and ascent steps.
SAMPLE_LINES, SEED, STEPS = 1500, 20, 100

#: The three base patterns and the characters that each needs.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")

CUES = frozenset("password passwd pwd pass secret token api apikey key credential credentials auth bearer private access authorization".split())
TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
_CANDIDATE = re.compile(r"[A-Za-z0-9]*(?:[0-9][A-Za-z]|[A-Za-z][0-9])[A-Za-z0-9]*|[A-Za-z0-9]{24,}|[0-9]{8,}|[A-Za-z0-9]*(?:[a-z][A-Z]|[A-Z]{2}[a-z]|[A-Z]{14})[A-Za-z0-9]*|[-=_+]")
_CUE = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(sorted(CUES, key=len, reverse=True)) + r")(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII)
_ODD = re.compile(r"[0-9]|[-=_+]|[a-z][A-Z]|[A-Z]{2}[a-z]|[A-Z]{14}|[A-Za-z0-9]{24,}")

OUT, BEGIN, IN = 0, 1, 2
#: The weight of what no tagging may do.
NEVER = -60.0

RESULT = [
    ("n_assign", T.LongType()),
    ("n_access", T.LongType()),
    ("n_hex", T.LongType()),
    ("n_crf", T.LongType()),
    ("base_sha256", T.StringType()),
    ("spans", T.StringType()),
    ("span_list", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _shape(token: str) -> str:
    """Length class and kinds of characters."""
    n = len(token)
    size = "1" if n == 1 else "s" if n < 8 else "m" if n < 14 else "l" if n < 24 else "x"
    if not token[0].isascii() or not token[0].isalnum():
        return "p" + (token if token in "=:\"'_-./+@,|<>" else "?")
    low, up, dig = any(c.islower() for c in token), any(c.isupper() for c in token), any(c.isdigit() for c in token)
    if low and up and not dig and token[1:].islower():
        up = False  # a capitalised word
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    return size + "a" * low + "A" * up + "9" * dig + ("t" if turns >= 3 else "")


def _plain(token: str) -> bool:
    return token.lower() not in CUES and not _CANDIDATE.fullmatch(token)


def file_facts(text: str) -> tuple[str, ...]:
    """Facts about the whole text that every one of its tokens carries."""
    ends = text.count(";\n") + text.count("{\n") + text.count("}\n")
    return ("code" if ends >= 2 else "prose", "assigns" if text.count("=") + text.count(": ") >= 4 else "few")


def features(tokens: list[str], facts: tuple[str, ...]) -> list[list[str]]:
    words = [t.lower() for t in tokens]
    shapes = [_shape(t) for t in tokens]
    out = []
    for i, s in enumerate(shapes):
        near = [w for w in words[max(0, i - 4) : i] if w in CUES]
        last = shapes[i - 1] if i else "^"
        after = shapes[i + 1] if i + 1 < len(shapes) else "$"
        out.append(["bias", f"s={s}", f"p={last}|{s}", f"n={s}|{after}", f"c={near[-1] if near else '-'}|{s}", f"w={'cue' if words[i] in CUES else '-'}", *(f"f={f}|{s}" for f in facts)])
    return out


def _sample(n_lines: int = SAMPLE_LINES, seed: int = SEED) -> list[tuple[list[str], list[int], tuple[str, ...]]]:
    """Synthetic labelled lines: prose, plain numbers and identifiers, and secrets of several makes."""
    rng = random.Random(seed)
    parts = "the of and to er in on that re sch ung keit ent que les eau ion ado os ez ar ment ou th nd".split()
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = letters + letters.upper() + digits

    def word() -> str:
        w = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        return w.capitalize() if rng.random() < 0.15 else w

    def run(chars: str, lo: int, hi: int) -> str:
        return "".join(rng.choice(chars) for _ in range(rng.randint(lo, hi)))

    def secret() -> str:
        return rng.choice(
            [
                lambda: run(mixed, 20, 44),
                lambda: run("0123456789abcdef", 18, 64),
                lambda: "sk-" + run(mixed, 24, 48),
                lambda: "ghp_" + run(mixed, 36, 36),
                lambda: f"xoxb-{run(digits, 10, 12)}-{run(mixed, 20, 24)}",
                lambda: f"eyJ{run(mixed, 20, 30)}.eyJ{run(mixed, 20, 40)}.{run(mixed, 30, 43)}",
                lambda: "AKIA" + run(letters.upper() + digits, 16, 16),
                lambda: run(mixed, 10, 20) + rng.choice("+/") + run(mixed, 10, 20) + "==",
            ]
        )()

    def chosen() -> str:
        """What a person might take as a password; only a cue word tells of it."""
        w = "".join(rng.choice(parts) for _ in range(rng.randint(2, 3)))
        return w + run(digits, 1, 4) + rng.choice(["", rng.choice("!?#$%*"), "".join(rng.choice(parts) for _ in range(2)) + rng.choice(["", "!"])])

    def harmless() -> str:
        return rng.choice(
            [
                lambda: run(digits, 1, 6),
                lambda: f"{rng.randint(1, 254)}.{rng.randint(0, 254)}.{rng.randint(0, 254)}.{rng.randint(1, 254)}",
                lambda: f"+{run(digits, 1, 2)}-{run(digits, 3, 3)}-{run(digits, 3, 4)}-{run(digits, 4, 4)}",
                lambda: f"{word()}.{word()}{run(digits, 1, 4)}@{word()}.example.com",
                lambda: f"20{run(digits, 2, 2)}-0{run('123456789', 1, 1)}-1{run(digits, 1, 1)}",
                lambda: word() + run(digits, 1, 4),
                lambda: f"https://{word()}.example.org/{word()}/{run(digits, 2, 5)}",
                lambda: "v" + run(digits, 1, 1) + "." + run(digits, 1, 2),
                lambda: f"{rng.choice(sorted(CUES))} {word()} {word()}",
                lambda: run(digits, 16, 16),
                lambda: word() * 3 + word(),
                lambda: "-".join(run("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)),
                lambda: f"data:image/png;base64,iVBORw0KGgo{run(mixed + '+/', 40, 120)}=",
                lambda: f"https://{word()}.example.com/{word()}/{run(mixed, 8, 24)}",
                lambda: f"https://{word()}.example.com/{word()}?id={run(mixed, 6, 16)}&ref={word()}",
                lambda: f"{word()}_{word()}{run(digits, 1, 2)}({word()})",
                lambda: (word() + rng.choice(["", word()])).upper() + rng.choice(["", "s", word().lower()]),
                lambda: (word() * rng.randint(1, 3)).upper(),
                lambda: rng.choice("!?#$%*&();") + rng.choice(["", " " + word()]),
            ]
        )()

    lines = []
    for k in range(n_lines):
        tokens: list[str] = []
        tags: list[int] = []

        def put(s: str, hidden: bool = False) -> None:
            own = TOKEN.findall(s)
            tokens.extend(own)
            tags.extend([OUT] * len(own) if not hidden else [BEGIN] + [IN] * (len(own) - 1))

        for _ in range(rng.randint(1, 8)):
            put(word())
        for _ in range(rng.randint(0, 3)):
            put(harmless())
            put(word() + rng.choice(["", "", "", "!", "?", ";", ","]))
        if k % 2:
            style = rng.randint(0, 6)
            cue = rng.choice(sorted(CUES))
            put({0: f"{cue} =", 1: f"{cue}:", 2: f'"{cue}": "', 3: f"{cue} is", 4: f"{word()}_{cue} = '", 5: "", 6: cue}[style])
            put(chosen() if style != 5 and (style == 6 or rng.random() < 0.3) else secret(), hidden=True)
            put({2: '"', 4: "'"}.get(style, ""))
        for _ in range(rng.randint(0, 6)):
            put(word())
        put(rng.choice([".", "", ",", ";"]))
        lines.append((tokens, tags, (rng.choice(["code", "prose"]), rng.choice(["assigns", "few"]))))
    return lines


class Model:
    """Weights of the field: features by tag, transitions, starts."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, step: np.ndarray, start: np.ndarray):
        self.index, self.emit, self.step, self.start = index, emit, step, start
        self.weight = {f: tuple(emit[i].tolist()) for f, i in index.items()}

    def scores(self, tokens: list[str], facts: tuple[str, ...]) -> list[tuple[float, float, float]]:
        """What the features of each token say for the three tags."""
        get, none = self.weight.get, (0.0, 0.0, 0.0)
        out = []
        for names in features(tokens, facts):
            x = y = z = 0.0
            for f in names:
                a, b, c = get(f, none)
                x, y, z = x + a, y + b, z + c
            out.append((x, y, z))
        return out

    def viterbi(self, emit: list[tuple[float, float, float]]) -> list[int]:
        steps = [tuple(self.step[:, t].tolist()) for t in (OUT, BEGIN, IN)]
        best = [s + e for s, e in zip(self.start.tolist(), emit[0], strict=True)]
        back = []
        for row in emit[1:]:
            o, b, i = best
            now, came = [], []
            for e, (so, sb, si) in zip(row, steps, strict=True):
                top, at = o + so, OUT
                if b + sb > top:
                    top, at = b + sb, BEGIN
                if i + si > top:
                    top, at = i + si, IN
                now.append(top + e)
                came.append(at)
            best = now
            back.append(came)
        tag = best.index(max(best))
        path = [tag]
        for came in reversed(back):
            tag = came[tag]
            path.append(tag)
        return path[::-1]

    def tag(self, line: str, facts: tuple[str, ...]) -> list[tuple[int, int]]:
        """Spans (within the line) of begin-inside runs."""
        pieces = list(TOKEN.finditer(line))
        if not pieces:
            return []
        spans: list[list[int]] = []
        for m, t in zip(pieces, self.viterbi(self.scores([m[0] for m in pieces], facts)), strict=True):
            if t == BEGIN:
                spans.append([m.start(), m.end()])
            elif t == IN:
                spans[-1][1] = m.end()
        return [(a, b) for a, b in spans]

    def plain_is_outside(self) -> bool:
        """Whether no stretch of plain tokens can gain by tags other than outside.

        The features of a plain token beside plain ones depend on its shape and its neighbours' shapes, and on
        the file's facts.  So the gain of a stretch over all-outside is the weight of a path through shapes
        and tags; the heaviest path is found by relaxation, and if it never ends the answer is no.
        """
        shapes = [f"{n}{k}" for n in "1sm" for k in "aA"] + ["la", "19", "s9", *("p" + c for c in ":\"'./@,|<>?")]
        zero = np.zeros(2)

        def gain(f: str) -> np.ndarray:
            row = self.emit[self.index[f]] if f in self.index else np.zeros(3)
            return row[1:] - row[0]

        after = np.array([[gain(f"p={x}|{y}") for y in shapes] for x in [*shapes, "^"]])  # shape before, shape, tag
        ahead = np.array([[gain(f"n={x}|{y}") for y in [*shapes, "$"]] for x in shapes])  # shape, shape ahead, tag
        step = self.step - self.step[OUT, OUT]
        for facts in ((a, b) for a in ("code", "prose") for b in ("assigns", "few")):
            node = np.array([sum((gain(f) for f in ("bias", "w=-", f"s={x}", f"c=-|{x}", f"f={facts[0]}|{x}", f"f={facts[1]}|{x}")), zero) for x in shapes])
            enter = np.maximum(after[:-1].max(0) + step[OUT, 1:], after[-1] + self.start[1:] - self.start[OUT])
            best = node + enter
            for turn in range(2 * len(shapes) + 1):
                ways = (best[:, None, :] + ahead[:, :-1])[..., None] + step[1:, 1:] + after[:-1, :, None, :]  # from, to, tag from, tag to
                now = np.maximum(best, ways.max((0, 2)) + node)
                if np.allclose(now, best, atol=1e-12):
                    break
                best = now
            else:
                return False
            if (best + np.maximum(ahead[:, :-1].max(1) + step[1:, OUT], ahead[:, -1])).max() >= 0:
                return False
        return True


@lru_cache(maxsize=1)
def trained() -> Model:
    """The field, fitted by gradient ascent on the log-likelihood of the synthetic lines."""
    lines = _sample()
    index: dict[str, int] = {}
    rows = [[[index.setdefault(f, len(index)) for f in names] for names in features(t, facts)] for t, _, facts in lines]
    width, long = max(len(r) for x in rows for r in x), max(len(x) for x in rows)
    pad = len(index)
    feats = np.full((len(rows), long, width), pad)
    tags = np.zeros((len(rows), long), dtype=np.int64)
    live = np.zeros((len(rows), long), dtype=bool)
    for i, (x, (_, y, _)) in enumerate(zip(rows, lines, strict=True)):
        for j, r in enumerate(x):
            feats[i, j, : len(r)] = r
        tags[i, : len(y)] = y
        live[i, : len(y)] = True
    weights = {"emit": np.zeros((pad + 1, 3)), "step": np.zeros((3, 3)), "start": np.zeros(3)}
    weights["step"][OUT, IN] = weights["start"][IN] = NEVER
    first, second = {k: np.zeros_like(v) for k, v in weights.items()}, {k: np.zeros_like(v) for k, v in weights.items()}
    gold = np.eye(3)[tags] * live[..., None]
    pairs = live[:, 1:]
    for n in range(1, STEPS + 1):
        emit = weights["emit"][feats].sum(2)
        step, alpha, beta = weights["step"], [weights["start"] + emit[:, 0]], [np.zeros((len(rows), 3))]
        for j in range(1, long):
            new = np.logaddexp.reduce(alpha[-1][:, :, None] + step, axis=1) + emit[:, j]
            alpha.append(np.where(live[:, j, None], new, alpha[-1]))
        for j in range(long - 1, 0, -1):
            new = np.logaddexp.reduce(step + (emit[:, j] + beta[0])[:, None, :], axis=2)
            beta.insert(0, np.where(live[:, j, None], new, beta[0]))
        a, b = np.stack(alpha, 1), np.stack(beta, 1)
        z = np.logaddexp.reduce(a[:, -1], axis=1)
        node = np.exp(a + b - z[:, None, None]) * live[..., None]
        edge = np.exp(a[:, :-1, :, None] + step + (emit + b)[:, 1:, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        error = gold - node
        grad = {"emit": np.zeros_like(weights["emit"]), "start": error[:, 0].sum(0), "step": np.einsum("ijk,ijl->kl", gold[:, :-1], gold[:, 1:]) - edge.sum((0, 1))}
        flat = feats.reshape(-1, width)
        for t in range(3):
            grad["emit"][:, t] = np.bincount(flat.ravel(), weights=np.repeat(error[..., t].ravel(), width), minlength=pad + 1)
        for k, w in weights.items():
            g = grad[k] / len(rows) - 2e-4 * w
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w += 0.12 * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
        weights["emit"][pad] = 0
        weights["step"][OUT, IN] = weights["start"][IN] = NEVER
    return Model(index, weights["emit"][:pad], weights["step"], weights["start"])


def crf_spans(text: str, model: Model, skip: bool = True) -> list[tuple[int, int]]:
    if skip and not _ODD.search(text) and not _CUE.search(text):
        return []
    facts, out, at = file_facts(text), [], 0
    for line in text.split("\n"):
        if not skip or _CANDIDATE.search(line) or _CUE.search(line):
            out.extend((at + a, at + b) for a, b in model.tag(line, facts))
        at += len(line) + 1
    return out


def all_spans(text: str, model: Model, skip: bool) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The patterns' spans, and these together with the field's."""
    base = base_spans(text)
    more = [(a, b, "crf") for a, b in crf_spans(text, model, skip) if not any(x <= a and b <= y for x, y, _ in base)]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with counts per kind, base_sha256, spans (a string) and span_list; see the module's text."""
    model = trained()
    skip = model.plain_is_outside()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(column: pa.Array) -> list[list]:
        out: list[list] = [[] for _ in RESULT]
        for t in column.to_pylist():
            base, spans = all_spans(t or "", shared.value, skip)
            kinds = [s[2] for s in spans]
            row = (*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), [{"kind": k, "start": a, "end": b} for a, b, k in spans])
            for x, y in zip(out, row, strict=True):
                x.append(y)
        return out

    return map_text(docs, text, fn, RESULT, keep)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Documents with every found span replaced by a mark; n_chars follows the new text if there is one."""

    model = trained()
    skip = model.plain_is_outside()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(column: pa.Array) -> list[list]:
        texts = [None if t is None else _masked(t, all_spans(t, shared.value, skip)[1], mark) for t in column.to_pylist()]
        return [texts]

    masked = map_text(docs.withColumn("__source__", docs[named(text)]), "__source__", fn, [(text, T.StringType())], others(docs, [text]))
    if "n_chars" in docs.columns:
        from pyspark.sql import functions as F

        masked = masked.withColumn("n_chars", F.when(F.col(named(text)).isNull(), F.col("n_chars")).otherwise(F.char_length(named(text)).cast(docs.schema["n_chars"].dataType)))
    return masked.select(*[named(c) for c in docs.columns])


def _masked(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """The text with a mark in place of each stretch that spans cover together; spans come by start."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out.append(text[at:a] + mark)
        at = max(at, b)
    return "".join(out) + text[at:]
