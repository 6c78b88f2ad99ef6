"""Train the weights of `pii` in numpy from labelled spans.

    python -m memoriq.llm.pii_train TABLES_DIR OUT.npz [STEPS HIDDEN [START.npz]]

Labelled spans come from a bounded sample of memories (`sample`, 12,000): mentions
and names of entities give name spans, patterns with their contexts the other
kinds. Each time a text is drawn its spans get fresh values of the same kind
(`Maker`), so that the model learns forms and contexts rather than values. Loss:
negative log-likelihood of a linear-chain CRF over the tags; optimiser: Adam.
"""

from __future__ import annotations

import random
import re
import sys
from collections import Counter

import numpy as np

from memoriq.llm.names import distance, fold, parse
from memoriq.llm.pii import CLASSES, KINDS, NEWLINE, STRIDE, TAGS, encode, load_weights, squash

HIDDEN = 32

_CAP = r"[A-ZÄÖÜ][\w'’-]+"
_STREET = r"(?:Street|St\.?|Road|Rd|Avenue|Ave|Lane|Ln|Close|Way|Drive|Court|Place|Square)"
_UNIT = r"(?:, (?:(?:Unit|Apt\.?|Flat|Suite|Apartment|No\.?|Piso) ?\w+|\d+º \w+))?"
_TOWN = rf"(?:, (?:{_CAP}(?: \d{{5}})?|\d{{5}} {_CAP}))?"
_ADDRESS = re.compile(
    rf"\b\d{{1,5}}[a-z]? {_CAP}(?: {_CAP})? {_STREET}(?![a-z]){_UNIT}{_TOWN}"
    rf"|\b{_CAP}(?:straße|strasse|str\.|weg|gasse|allee|platz) \d{{1,4}}[a-z]?{_UNIT}{_TOWN}"
    rf"|\b(?:Calle|Avenida|Plaza|Paseo) {_CAP} \d{{1,4}}[a-z]?{_UNIT}{_TOWN}"
)
_EMAIL = re.compile(
    r"[A-Za-z0-9][\w.%+-]*(?:\s?@\s?|\s?[(\[]at[)\]]\s?)[A-Za-z0-9-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?)[A-Za-z0-9-]+)+"
    r"|[A-Za-z0-9][\w.%+-]* at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+"
)
_ID = re.compile(r"(?:(?<=DNI es )|(?<=number )|(?<=on file: )|(?<=clinic )|(?<=\bID ))[A-Z0-9][A-Z0-9 -]*\d(?:[ -]?[A-Z]\b)?")
_PHONE = re.compile(r"(?<![\w.+-])(?:\+|00|\()?\d[\d ()./-]{7,20}\d(?!\w)")
_NO_PHONE = re.compile(r"(?:Order|Version|Lot|Ticket|[Tt]ask|[Cc]ommit|number|file:|clinic|ID|DNI es|dump=|ms=) $")
_PAIR = re.compile(r"(?:[^\W\d_]\.|[^\W\d_]+)(?:, | +)(?:[^\W\d_]\. )?(?:[^\W\d_]\.|[^\W\d_]+)|[^\W\d_]+")


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    for pattern, kind in ((_ID, "id_number"), (_ADDRESS, "address"), (_PHONE, "phone")):
        for m in pattern.finditer(text):
            if any(a < m.end() and m.start() < b for a, b, _ in out):
                continue
            if kind == "phone" and (_NO_PHONE.search(text[max(0, m.start() - 12) : m.start()]) or not 9 <= len(re.sub(r"\D", "", m.group())) <= 15):
                continue
            out.append((m.start(), m.end(), kind))
    return out


#: Capitalised words one letter from a given name.
_PLAIN = set("call lake bei en in at mit con met ring mount saint north the over quiet near told read nora's".split())


class Names:
    """Given names and surnames of the entities, and name spans in a text by them."""

    def __init__(self, entities):
        given, self.surnames, people = Counter(), Counter(), []
        for name, kind, aliases in entities:
            if kind == "PersonalName":
                people += [s for s in [name, *(aliases if aliases is not None else [])] if s]
        for s in people:
            words = [t for t, k in parse(s) if k == "w"]
            if len(words) == 2:
                given[words[0]] += 1
                self.surnames[words[1]] += 1
        self.given = {g for g, n in given.items() if n >= 4 and n > self.surnames[g]}
        self.surnames = Counter({s: n for s, n in self.surnames.items() if s not in self.given and len(s) > 5})
        self._known: dict = {}

    def _role(self, word: str) -> str:
        w = fold(word).lower().rstrip(".")
        if w not in self._known:
            role = "i" if len(w) == 1 else "-" if w in _PLAIN else ""
            if not role and (w in self.given or any(abs(len(g) - len(w)) < 2 and distance(g, w, 1) < 2 for g in self.given if len(w) > 3)):
                role = "g"
            if not role and (w in self.surnames or (len(w) > 6 and any(s[0] == w[0] and abs(len(s) - len(w)) < 2 and distance(s, w, 1) < 2 for s in self.surnames))):
                role = "s"
            if not role and word[:2].isupper() and len(word) == 2:
                role = "i"
            self._known[w] = role.strip("-")
        return self._known[w]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        out = []
        tokens = [(m.start(), m.end(), self._role(m.group())) for m in re.finditer(r"[^\W\d_]+", text)]
        at = 0
        while at < len(tokens):
            a, b, role = tokens[at]
            joined = re.fullmatch(r"([A-Z][a-zà-ÿ]+)([A-Z][a-z]+)", text[a:b])
            if joined and self._role(joined[1]) == "g" and self._role(joined[2]) == "s":
                out.append((a, b, "name"))
            elif role and at + 1 < len(tokens):
                c, d, second = tokens[at + 1]
                gap = text[b:c]
                third = tokens[at + 2] if at + 2 < len(tokens) else None
                if role in "gi" and second == "i" and third and third[2] == "s" and gap.strip() in ("", ".") and text[d : third[0]].strip() in ("", "."):
                    out.append((a, third[1], "name"))
                    at += 2
                elif {role, second} in ({"g", "s"}, {"i", "s"}) and re.fullmatch(r"\.? +|, ", gap) and not (role == "s" and second == "i" and gap != ", "):
                    if not (role == "i" and (text[a:b].islower() or gap.strip() != "." and b - a == 1)):
                        end = d + (second == "i" and text[d : d + 1] == ".")
                        out.append((a, end, "name"))
                        at += 1
            at += 1
        return out


class Maker:
    """Fresh values: every draw of a training text gets new names, numbers and addresses in the form of the old."""

    def __init__(self, names: Names, rng: random.Random):
        self.rng = rng
        self.given = sorted(names.given)
        self.tails = sorted({s[-k:] for s in names.surnames for k in (4, 5)})

    def stem(self, n: int) -> str:
        return "".join(self.rng.choice("bdfgklmnprstvwz") + self.rng.choice("aeiou") for _ in range(n))

    def surname(self) -> str:
        return (self.stem(self.rng.choice((2, 3, 3))) + self.rng.choice(self.tails)).capitalize()

    def like(self, old: str, kind: str) -> str:
        rng = self.rng
        if kind in ("phone", "id_number"):
            return "".join(
                rng.choice("0123456789") if c.isdigit() and rng.random() < 0.7 else rng.choice("ABCDEFGHKLMNPQRSTVWXYZ") if c.isupper() else c for c in old
            )
        if kind == "name":
            if rng.random() < 0.3:
                return old
            def swap(m):
                w = m.group()
                low = fold(w).lower()
                if len(w) <= 2:
                    return rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") + w[1:] if w.isupper() else w
                new = rng.choice(self.given).capitalize() if low in self.given else self.surname()
                return new.upper() if w.isupper() else new.lower() if w.islower() else new
            return re.sub(r"[^\W\d_]+", swap, old)
        if kind == "address":
            def swap(m):
                w = m.group()
                if re.fullmatch(_STREET + r"|Unit|Apt|Flat|Suite|Apartment|No|Piso|Calle|Avenida|Plaza|Paseo", w) or len(w) < 5:
                    return w
                tail = re.search(r"(?:straße|strasse|str|weg|gasse|allee|platz)$", w)
                keep = w[-rng.choice((3, 4, 5)) :] if not tail else w[-len(tail[0]) - 4 :]
                return (self.stem(2) + keep).capitalize()
            new = re.sub(r"\d", lambda m: rng.choice("0123456789"), re.sub(r"[^\W\d_]+", swap, old))
            return rng.choice((new.lower(), new.upper())) if rng.random() < 0.15 else new
        return re.sub(r"[a-z]{4,}", lambda m: m.group() if m.group() in ("example", "invalid", "test", "mail", "notes") or rng.random() < 0.3 else self.stem(max(2, len(m.group()) // 2)), old)

    def text(self, text: str, spans: list) -> tuple[str, list]:
        out, new, at, n = [], [], 0, 0
        for a, b, kind in sorted(spans):
            if a < at:
                continue
            value = self.like(text[a:b], kind)
            out += [text[at:a], value]
            n += a - at
            new.append((n, n + len(value), kind))
            n += len(value)
            at = b
        return "".join(out) + text[at:], new


def tags_of(n: int, spans: list):
    y = np.zeros(n, np.int8)
    for a, b, kind in spans:
        y[a:b] = 1 + KINDS.index(kind)
    return y


def initial(seed: int, h: int = HIDDEN) -> dict:
    g = np.random.default_rng(seed)
    bias = np.zeros(3 * h)
    bias[:h] = 1.0
    return {
        "wx": (g.normal(0, 0.3, (2, STRIDE, CLASSES, 3 * h)) + bias / STRIDE).astype(np.float32),
        "wh": g.normal(0, h**-0.5, (2, h, 3 * h)).astype(np.float32),
        "wo": g.normal(0, h**-0.5, (2 * h, STRIDE * TAGS)).astype(np.float32),
        "bo": np.zeros(STRIDE * TAGS, np.float32),
        "trans": np.zeros((TAGS, TAGS), np.float32),
    }


def slope(s):
    """The derivative of `squash` where its value is s."""
    return (1 - np.abs(s)) ** 2


def loss_and_grads(p: dict, x, y) -> tuple[float, dict]:
    """Mean CRF loss per character of full windows x, y (B, T), T a multiple of STRIDE, and its gradients."""
    b, t = x.shape
    n = t // STRIDE
    h = p["wh"].shape[1]
    cells = x.reshape(b, n, STRIDE)
    both = np.stack([cells, cells[:, ::-1]])  # (2, B, N, STRIDE)
    H = np.zeros((n + 1, 2, b, h), np.float32)
    C = np.zeros((n + 1, 2, b, h), np.float32)
    G = np.empty((n, 2, b, 3 * h), np.float32)
    TC = np.empty((n, 2, b, h), np.float32)
    scratch = np.empty((2, b, 3 * h), np.float32)
    for k in range(n):
        z = np.matmul(H[k], p["wh"])
        for d in (0, 1):
            for q in range(STRIDE):
                z[d] += p["wx"][d, q][both[d, :, k, q]]
        z[:, :, : 2 * h] *= 0.5
        squash(z, z, scratch)
        z[:, :, : 2 * h] = z[:, :, : 2 * h] * 0.5 + 0.5
        G[k] = z
        C[k + 1] = z[:, :, 2 * h :] + z[:, :, :h] * (C[k] - z[:, :, 2 * h :])
        squash(C[k + 1], TC[k])
        H[k + 1] = z[:, :, h : 2 * h] * TC[k]
    hidden = np.concatenate([H[1:, 0], H[1:, 1][::-1]], axis=2)  # (N, B, 2H)
    s = (hidden @ p["wo"] + p["bo"]).reshape(n, b, STRIDE, TAGS).transpose(0, 2, 1, 3).reshape(t, b, TAGS)
    # CRF: forward and backward sums
    tr = p["trans"]
    et = np.exp(tr)
    alpha = np.empty((t, b, TAGS), np.float32)
    logz = np.zeros(b)
    m = s.max(2, keepdims=True)
    es = np.exp(s - m)
    a = es[0]
    norm = a.sum(1, keepdims=True)
    alpha[0] = a / norm
    logz += np.log(norm[:, 0]) + m[0, :, 0]
    for k in range(1, t):
        a = (alpha[k - 1] @ et) * es[k]
        norm = a.sum(1, keepdims=True)
        alpha[k] = a / norm
        logz += np.log(norm[:, 0]) + m[k, :, 0]
    beta = np.ones((b, TAGS), np.float32)
    marg = np.empty_like(alpha)
    gt = np.zeros((TAGS, TAGS))
    marg[t - 1] = alpha[t - 1] / alpha[t - 1].sum(1, keepdims=True)
    for k in range(t - 2, -1, -1):
        eb = es[k + 1] * beta
        scale = 1 / ((alpha[k] @ et) * eb).sum(1)
        gt += et * (alpha[k].T @ (eb * scale[:, None]))
        beta = eb @ et.T
        beta /= beta.max(1, keepdims=True)
        q = alpha[k] * beta
        marg[k] = q / q.sum(1, keepdims=True)
    yt = y.T
    gold = np.take_along_axis(s, yt[:, :, None].astype(np.int64), 2).sum((0, 2)) + tr[yt[:-1], yt[1:]].sum(0)
    loss = float((logz - gold).sum() / (b * t))
    ds = marg
    np.put_along_axis(ds, yt[:, :, None].astype(np.int64), np.take_along_axis(ds, yt[:, :, None].astype(np.int64), 2) - 1, 2)
    ds /= b * t
    np.add.at(gt, (yt[:-1].ravel(), yt[1:].ravel()), -1)
    ds = ds.reshape(n, STRIDE, b, TAGS).transpose(0, 2, 1, 3).reshape(n, b, STRIDE * TAGS)
    g = {"trans": (gt / (b * t)).astype(np.float32), "bo": ds.sum((0, 1)), "wo": np.tensordot(hidden, ds, ([0, 1], [0, 1]))}
    dh = ds @ p["wo"].T
    dH = np.stack([dh[:, :, :h], dh[::-1, :, h:]], axis=1)
    dz = np.empty_like(G)
    nh = np.zeros((2, b, h), np.float32)
    nc = np.zeros((2, b, h), np.float32)
    wt = p["wh"].transpose(0, 2, 1)
    for k in range(n - 1, -1, -1):
        f, o, c = (G[k][:, :, j * h : (j + 1) * h] for j in range(3))
        d = dH[k] + nh
        dc = nc + d * o * slope(TC[k])
        z = dz[k]
        z[:, :, :h] = dc * (C[k] - c) * slope(2 * f - 1) / 4
        z[:, :, h : 2 * h] = d * TC[k] * slope(2 * o - 1) / 4
        z[:, :, 2 * h :] = dc * (1 - f) * slope(c)
        nc = dc * f
        nh = np.matmul(z, wt)
    g["wh"] = np.stack([np.tensordot(H[:-1, k], dz[:, k], ([0, 1], [0, 1])) for k in (0, 1)])
    g["wx"] = np.zeros_like(p["wx"])
    for k in (0, 1):
        for q in range(STRIDE):
            ids = both[k, :, :, q].T.ravel()
            order = np.argsort(ids, kind="stable")
            flat = dz[:, k].reshape(-1, 3 * h)[order]
            at = np.flatnonzero(np.diff(ids[order], prepend=-1))
            g["wx"][k, q][ids[order][at]] = np.add.reduceat(flat, at, axis=0)
    return loss, g


def train(examples: list, steps: int = 2500, batch: int = 64, window: int = 128, rate: float = 6e-3, seed: int = 5, maker: Maker | None = None, hidden: int = HIDDEN, log=print, start: dict | None = None) -> dict:
    """Weights for `pii` from (text, spans) examples, trained on from `start` if given."""
    rng = random.Random(seed)
    p = {k: v.copy() for k, v in start.items()} if start else initial(seed, hidden)
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    by_kind = {k: found for k in KINDS if (found := [e for e in examples if any(s[2] == k for s in e[1])])}
    kinds = [k for k in by_kind for _ in range(2 if k == "name" else 1)]
    running = 0.0
    for step in range(1, steps + 1):
        x, y = np.zeros((batch, window), np.uint8), np.zeros((batch, window), np.int8)
        for r in range(batch):
            kind = rng.choice(kinds) if kinds and rng.random() < 0.75 else None
            text, spans = rng.choice(by_kind[kind] if kind else examples)
            if maker:
                text, spans = maker.text(text, spans)
            code, tags = encode(text), tags_of(len(text), spans)
            at = rng.randrange(-window // 4, max(1, len(text) - window // 2))
            if kind and rng.random() < 0.9:
                a, b, _ = rng.choice([s for s in spans if s[2] == kind])
                at = (a + b) // 2 - rng.randrange(window // 8, window - window // 8)
            at = max(0, min(at, len(text) - window))
            n = min(window, len(text) - at)
            x[r, :n], y[r, :n] = code[at : at + n], tags[at : at + n]
            x[r, n:] = NEWLINE
        loss, g = loss_and_grads(p, x, y)
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        lr = rate * min(1, step / 100) * (1 - 0.97 * step / steps)
        for k in p:
            v = g[k] * min(1, 0.5 / (norm + 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.995 * m2[k] + 0.005 * v * v
            p[k] -= lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.995**step)) + 1e-8)
        running = loss if step == 1 else 0.98 * running + 0.02 * loss
        if step % 100 == 0:
            log(step, round(running, 5), flush=True)
    return p


def labelled(tables: str, sample: int = 12_000, seed: int = 3) -> tuple[list, Names]:
    """(text, spans) of a bounded sample of memories, by names of entities and patterns."""
    import pyarrow.parquet as pq

    e = pq.read_table(f"{tables}/entities.parquet", columns=["canonical_name", "entity_type", "aliases"]).to_pydict()
    names = Names(list(zip(e["canonical_name"], e["entity_type"], e["aliases"], strict=True)))
    texts = sorted({t for t in pq.read_table(f"{tables}/memories.parquet", columns=["text"])["text"].to_pylist() if t})
    random.Random(seed).shuffle(texts)
    out = []
    for t in texts[:sample]:
        spans = pattern_spans(t)
        spans += [s for s in names.spans(t) if not any(a < s[1] and s[0] < b for a, b, _ in spans)]
        out.append((t, sorted(spans)))
    return out, names


def main(tables: str, out: str, steps: str = "5000", hidden: str = str(HIDDEN), start: str = "") -> None:
    examples, names = labelled(tables)
    held, used = examples[:800], examples[800:]
    w = train(used, steps=int(steps), hidden=int(hidden), maker=Maker(names, random.Random(11)), start=load_weights(start) if start else None)
    np.savez_compressed(out, **{k: v.astype(np.float16 if k in ("wx", "wh") else np.float32) for k, v in w.items()})
    print(score(held, w), "network alone:", score(held, w, check=False))


def score(examples: list, weights: dict, check: bool = True) -> dict:
    """Spans wanted, exact-span precision and recall per kind; without `check` those of the network alone."""
    from memoriq.llm.pii import label_texts, prepared

    found = label_texts([t for t, _ in examples], prepared(weights), check=check)
    out = {}
    for kind in KINDS:
        want = {(i, a, b) for i, (_, s) in enumerate(examples) for a, b, k in s if k == kind}
        got = {(i, a, b) for i, s in enumerate(found) for a, b, k in s if k == kind}
        out[kind] = (len(want), round(len(want & got) / max(1, len(got)), 3), round(len(want & got) / max(1, len(want)), 3))
    return out


if __name__ == "__main__":
    main(*sys.argv[1:])
