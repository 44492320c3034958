"""Personal data: exact patterns, and a skip-chain conditional random field that decides about all other tokens.

The patterns give base spans, which stay. The nodes of a random field over {none, email, ip, card, phone} are
tokens that hold a digit or an at sign, masked numbers, and words that could stand for an address of the text;
all other tokens are none. A node's own potential is a softmax over its form and the words around it, and nodes
under a base span are held at its label. Neighbours in the text share a chain potential. Mentions of one value
(equal, or with equal digits) share a skip potential, and similar ones (a masked or once mistyped number, the
name before an address's at sign) another, however far apart they are. Loopy belief propagation gives
marginals, and a node that is surely of a kind becomes a span, whatever the patterns say.

The weights are maximum a posteriori estimates: base spans of all documents are the labels, and where those say
nothing the prior speaks, by which mentions of a value agree and words such as "tel" announce a kind.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, doc_text, slices, sole_cache

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT, _TOKEN = re.compile("[0-9]"), re.compile(r"\S+")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&=_~^/\\"


def _number_up_to(text: str, most: int) -> bool:
    text = text.lstrip("0")
    return len(text) <= 4 and int(text or "0") <= most


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind, then start. Linear in the
    text: an at sign's local part is read backwards, and runs of digits are never tried twice."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                out.append((0, start, end))
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(_number_up_to(p, 255) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def valid_form(kind: int, core: str) -> bool:
    """Is the token by itself a value of that kind?"""
    if kind == 0:
        return _EMAIL.fullmatch(core) is not None
    if kind == 1:
        return _IP.fullmatch(core) is not None and all(_number_up_to(p, 255) for p in core.split("."))
    digits = core.replace("-", "")
    return kind == 2 and digits.isdigit() and digits.isascii() and 16 <= len(digits) <= 19 and luhn(digits)


#: Words that announce a kind, in the languages at hand.
CUES = (
    frozenset("mail email mailto courriel correo".split()),
    frozenset("ip host server address adresse dirección".split()),
    frozenset("card visa mastercard amex credit carte karte kreditkarte tarjeta".split()),
    frozenset("tel phone call mobile fax telefon tél téléphone handy teléfono móvil".split()),
)
_AT, _DOT = re.compile(r"[(\[{]at[)\]}]", re.I), re.compile(r"[(\[{]dot[)\]}]", re.I)
_MASKED = re.compile(r"(?:[*#•]{2,}|(?<![A-Za-z0-9])[xX]{2,})[*#•xX -]*([0-9]{3,4})(?![0-9])")
_CANDIDATE = re.compile(r"[0-9@]|[(\[{][aA][tT][)\]}]")
_BARE = re.compile(r"[^\W\d_]+")
FEATURES = 24


def _one_edit(a: str, b: str) -> bool:
    """Do the strings differ by one character changed, added or left out, or by two neighbours changed over?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]


#: An odd number, and what undoes a multiplication by it in 64 bits.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _one_edit_pairs(values: list[str]) -> list[tuple[int, int]]:
    """Places of all pairs of the different strings of digits that are one edit apart. A changed digit leaves
    equal hashes where that digit is open, a digit left out and two changed over make the other's hash: those are
    sorted and looked up, whatever strings share, and each pair found is checked. So the work goes with the
    digits and the pairs, of which a card number has a few hundred at most."""
    if len(values) < 2:
        return []
    sizes = np.array([len(v) for v in values])
    own, ends = np.repeat(np.arange(len(values)), sizes), np.cumsum(sizes)
    starts = ends - sizes
    digit = np.frombuffer("".join(values).encode(), np.uint8).astype(np.uint64) - np.uint64(47)
    weight = np.cumprod(np.full(sizes.max(), _STEP, np.uint64))[np.arange(len(own)) - starts[own]]
    part = digit * weight
    total = np.cumsum(part)
    before = total - part - (total - part)[starts][own]
    whole = before[ends - 1] + part[ends - 1]
    opened = whole[own] - part + np.uint64(11) * weight
    shorter = before + (whole[own] - before - part) * np.uint64(_BACK)
    k = np.flatnonzero(own[:-1] == own[1:])
    swapped = whole[own[k]] + (digit[k + 1] - digit[k]) * (weight[k] - weight[k + 1])
    found = []
    for keys, of, among, at in ((opened, own, opened, own), (shorter, own, whole, np.arange(len(values))), (swapped, own[k], whole, np.arange(len(values)))):
        order = np.argsort(among)
        first, end = (np.searchsorted(among, keys, side, order) for side in ("left", "right"))
        while len(first := first[live := first < end]):
            of, end = of[live], end[live]
            other = at[order[first]]
            found.append(np.unique(np.minimum(of, other) * len(values) + np.maximum(of, other)))
            first = first + 1
    pairs = np.unique(np.concatenate(found)).tolist()
    return [(i, j) for i, j in (divmod(x, len(values)) for x in pairs) if _one_edit(values[i], values[j])]


class Nodes:
    """Candidate tokens of a text: places without outer punctuation, features, base labels and edges."""

    def __init__(self, text: str, base: list[Span]):
        self.places: list[tuple[int, int]] = []
        # the name before an address's at sign may stand for it elsewhere, if it does not look like a word
        handles = {h for k, a, b in base if k == 0 and len(h := text[a : text.index("@", a)].lower()) >= 5 and not h.isalpha()}
        cores, features, cue = [], [], [0, 0, 0, 0]  # how many tokens a cue word still reaches
        last, plus = -9, -9  # ends of the last node and of the last run that a plus sign began
        gaps = []
        for m in _TOKEN.finditer(text):
            token = m[0]
            core = token.lstrip(_EDGE).rstrip(_EDGE)
            masked = _MASKED.search(token)
            if core and (_CANDIDATE.search(token) or core.lower() in handles) or masked:
                if masked and not core.strip("xX- "):
                    core = masked[0]
                start = m.start() + token.find(core)
                if masked and masked.end() >= len(token.rstrip(_EDGE)):
                    start, core = m.start() + masked.start(), masked[0]
                led = start - plus <= 3
                features.append(self._features(core, bool(masked), core.lower() in handles, led, [c > 0 for c in cue]))
                cores.append(core)
                gaps.append(start - last)
                last = start + len(core)
                self.places.append((start, last))
                if led or core[0] == "+":
                    plus = last
            cue = [c - 1 for c in cue]
            for word in _BARE.findall(token.lower()) if len(token) <= 40 else ():
                for k, words in enumerate(CUES):
                    if word in words:
                        cue[k] = 3
        self.cores, n = cores, len(cores)
        self.features = np.array(features, np.float64).reshape(n, FEATURES)
        self.label = np.zeros(n, np.int64)
        starts = np.array([p[0] for p in self.places], np.int64)
        ends = np.array([p[1] for p in self.places], np.int64)
        for kind, a, b in reversed(base):
            # spans and nodes are both in order, so a span's nodes are a run
            self.label[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)] = kind + 1
        at = np.flatnonzero(np.array(gaps[1:], np.int64) <= 3)
        self.chain = np.stack([at, at + 1], axis=1)
        self.skip, self.alike = self._edges()

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges between mentions of one value, and between similar ones. A mention meets the one of its value
        before it and the first one under a base span. For each value one mention stands, the first under a base
        span if there is one. Where all values of two sides are alike (masked and whole numbers of one tail,
        names and addresses), a mention meets the one that stands for the other side, on the side of names the
        bare one. Numbers one edit apart all meet: those that stand for two such values do, and other mentions
        meet one of the values like theirs. So a text has few edges a node, and one for each pair of numbers."""
        same: dict[str, list[int]] = {}
        veiled: dict[str, list[int]] = {}
        sides: dict[str, tuple[list[int], list[int]]] = {}
        numbers: dict[str, list[int]] = {}
        skip, alike = [], []

        def meet(met: dict[str, list[int]], key: str, i: int, out: list) -> None:
            if key in met:
                out += [(j, i) for j in dict.fromkeys(met[key])]
                if self.label[i] and not self.label[met[key][0]]:
                    met[key][0] = i
                met[key][1] = i
            else:
                met[key] = [i, i]

        mails = [_DOT.sub(".", _AT.sub("@", core.lower())) for core in self.cores]
        for i, (core, mail) in enumerate(zip(self.cores, mails)):
            n, plain = "".join(_DIGIT.findall(core)), not any(c.isalpha() for c in core)
            if _MASKED.fullmatch(core):
                meet(veiled, n[-4:], i, alike)
                sides.setdefault("tail" + n[-4:], ([], []))[0].append(i)
            elif len(n) >= 7 and plain:
                meet(same, "#" + n[-10:], i, skip)
                sides.setdefault("tail" + n[-4:], ([], []))[1].append(i)
                if len(n) >= 12:
                    numbers.setdefault(n, []).append(i)
            elif len(core) >= 5:
                meet(same, mail, i, skip)
                sides.setdefault("name" + mail.split("@")[0], ([], []))["@" in core].append(i)

        def stands(mentions: list[int]) -> int:
            return min(mentions, key=lambda i: ("@" in mails[i], not self.label[i], i))

        for one, other in sides.values():
            if one and other:
                a, b = stands(one), stands(other)
                alike += [(a, i) for i in other] + [(b, i) for i in one]
        first = [stands(m) for m in numbers.values()]
        near: dict[int, list[int]] = {}
        for a, b in _one_edit_pairs(list(numbers)):
            alike.append((first[a], first[b]))
            near.setdefault(a, []).append(first[b])
            near.setdefault(b, []).append(first[a])
        for k, mentions in enumerate(numbers.values()):
            if k in near:
                j = stands(near[k])
                alike += [(j, i) for i in mentions]
        return tuple(np.array(sorted({(min(e), max(e)) for e in edges}), np.int64).reshape(-1, 2) for edges in (skip, alike))

    @staticmethod
    def _features(core: str, masked: bool, handle: bool, led: bool, cue: list[bool]) -> list[float]:
        n = len(_DIGIT.findall(core))
        size = sum(n >= s for s in (1, 4, 7, 8, 12, 16, 20))
        disguised = bool(_AT.search(core)) and valid_form(0, _DOT.sub(".", _AT.sub("@", core)))
        own = [True, "@" in core, valid_form(0, core), valid_form(1, core), valid_form(2, core), core[0] == "+", any(c.isalpha() for c in core), "-" in core]
        return [float(x) for x in (*own, *(size == k for k in range(8)), led, masked, disguised, handle, *cue)]


def _prior() -> np.ndarray:
    """The weights' prior means: a form in disguise is an address, masked numbers and names before an at sign
    are what their like is, and words announce their kind."""
    w = np.zeros((FEATURES, len(KINDS) + 1))
    w[17, 3], w[18, 1], w[19, 1] = 3, 6, 3.5
    for k in range(len(KINDS)):
        w[20 + k, k + 1] = 1.5
    return w


class SkipChain:
    """Potentials of the field and inference in it."""

    def __init__(self, own: np.ndarray | None = None, chain: np.ndarray | None = None, skip: np.ndarray | None = None, alike: np.ndarray | None = None):
        k = len(KINDS) + 1
        self.own = _prior() if own is None else own
        self.chain = np.zeros((k, k)) if chain is None else chain
        self.skip = np.eye(k) * 2 if skip is None else skip
        self.alike = np.eye(k) * 2 if alike is None else alike

    @staticmethod
    def counts(text: str) -> Counter:
        """What a text teaches: how often a form has a label, and how often the ends of edges have theirs. The
        patterns know nothing of masked and disguised forms, nor of mentions of a base span that they left out:
        those are what the field is to decide, and teach nothing."""
        base = base_spans(text)
        nodes, found = Nodes(text, base), Counter()
        judged = ~nodes.features[:, 17:20].any(axis=1)
        edges = np.concatenate([nodes.skip, nodes.alike])
        for i, j in ((0, 1), (1, 0)):
            judged[edges[(nodes.label[edges[:, i]] == 0) & (nodes.label[edges[:, j]] > 0), i]] = False
        found.update(("own", f.astype(np.uint8).tobytes(), int(y), 0) for f, y, ok in zip(nodes.features, nodes.label, judged) if ok)
        for name in ("chain", "skip", "alike"):
            found.update((name, b"", int(nodes.label[i]), int(nodes.label[j])) for i, j in getattr(nodes, name) if judged[i] and judged[j])
        return found

    @classmethod
    def fit(cls, counts: Counter, steps: int = 400, rate: float = 0.5, ridge: float = 1e-4) -> SkipChain:
        """Piecewise: the softmax by gradient descent from its prior, the pair potentials as log ratios of joint
        to single frequencies. Without examples only the priors remain."""
        k, names = len(KINDS) + 1, ("chain", "skip", "alike")
        seen = sorted(((f, y), n) for (part, f, y, _), n in counts.items() if part == "own")
        w = _prior()
        if seen:
            x = np.frombuffer(b"".join(f for (f, _), _ in seen), np.uint8).reshape(-1, FEATURES).astype(np.float64)
            target, n = np.eye(k)[[y for (_, y), _ in seen]], np.array([n for _, n in seen], np.float64)
            n /= n.sum()
            for _ in range(steps):
                e = x @ w
                p = np.exp(e - e.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                w -= rate * (x.T @ ((p - target) * n[:, None]) + ridge * (w - _prior()))
        # mentions of one value agree, similar ones nearly so: worth some hundred examples where there are none
        joint = dict(zip(names, (np.ones((k, k)), np.ones((k, k)) + 200 * np.eye(k), np.ones((k, k)) + 100 * np.eye(k))))
        for (part, _, a, b), n in counts.items():
            if part != "own":
                joint[part][a, b] += n
        pairs = []
        for name in names:
            j = (joint[name] + joint[name].T) / (2 * joint[name].sum())
            pairs.append(np.clip(np.log(j / np.outer(j.sum(0), j.sum(0))), -4, 4))
        return cls(w, np.clip(pairs[0], -2, 2), *pairs[1:])

    def marginals(self, nodes: Nodes, held: float = 12.0, damping: float = 0.3) -> np.ndarray:
        """Sum-product messages along all edges at once, damped, until they settle; that takes fewer rounds than
        there are nodes, and some dozens where a loop keeps them moving."""
        own = nodes.features @ self.own
        covered = nodes.label > 0
        kinds = [(getattr(nodes, name), np.exp(getattr(self, name))) for name in ("chain", "skip", "alike")]
        edges = np.concatenate([e for e, _ in kinds])
        # however many edges a held node has, they don't outvote its label
        most = max(np.ptp(p) for p in (self.chain, self.skip, self.alike)) * np.bincount(edges.ravel(), minlength=len(own))
        own[covered, nodes.label[covered]] += held + most[covered]
        if len(edges):
            potential = np.concatenate([np.repeat(p[None], len(e), 0) for e, p in kinds])
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
            back = np.r_[len(edges) : 2 * len(edges), 0 : len(edges)]
            message = np.zeros((len(source), own.shape[1]))
            for _ in range(len(own) + 60):
                belief = own.copy()
                np.add.at(belief, target, message)
                out = belief[source] - message[back]
                out = np.exp(out - out.max(1, keepdims=True))
                new = np.log(np.einsum("ei,eij->ej", out, potential))
                new -= new.mean(1, keepdims=True)
                moved = np.abs(new - message).max()
                message = damping * message + (1 - damping) * new
                if moved < 1e-3:
                    break
            np.add.at(own, target, message)
        p = np.exp(own - own.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def spans(self, text: str, base: list[Span] | None = None, sure: float = 0.8) -> list[Span]:
        """Base spans and what the field adds, by kind, then start; added ones never overlap a span."""
        base = base_spans(text) if base is None else base
        if not _CANDIDATE.search(text):
            return base
        nodes = Nodes(text, base)
        free = np.flatnonzero(nodes.label == 0)
        if not len(free):
            return base
        p = self.marginals(nodes)
        best = p.argmax(1)
        merged: list[Span] = []
        certain = p.max(1) >= sure
        # a likely token beside a sure one of its kind goes with it
        for edges in (nodes.chain, nodes.chain[::-1, ::-1]):
            for i, j in edges:
                certain[j] |= certain[i] and best[i] == best[j] and nodes.label[i] == 0
        for i in free:
            k = int(best[i])
            if k and certain[i]:
                kind, (a, b) = k - 1, nodes.places[i]
                # a phone number, or a card's, may be several tokens
                if merged and merged[-1][0] == kind and kind >= 2 and a - merged[-1][2] <= 2 and not valid_form(2, nodes.cores[i]):
                    merged[-1] = (kind, merged[-1][1], b)
                else:
                    merged.append((kind, a, b))
        return sorted(base + merged)


def train(docs: DataFrame) -> SkipChain:
    """The field's potentials from all documents.

    Tasks count what their texts teach; what comes to the driver is a row for each pattern of a token's 24 yes
    or no features and for each pair of labels, whose number does not grow with the documents. Null and empty
    texts teach nothing, and an empty table leaves the priors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("pii", lambda: None)
        found: Counter = Counter()
        for b in slices(batches):
            for text in b.column(1).to_pylist():
                found.update(SkipChain.counts(text))
        rows = [(*key, n) for key, n in found.items()]
        types = pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["part", "form", "a", "b", "n"])

    texts = doc_text(docs).filter(F.col("text").rlike(r"[0-9@]"))
    counted = texts.mapInArrow(run, "part string, form binary, a int, b int, n long").groupBy("part", "form", "a", "b").agg(F.sum("n").alias("n"))
    return SkipChain.fit(Counter({(r["part"], bytes(r["form"]), r["a"], r["b"]): r["n"] for r in counted.collect()}))


def text_of(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find_pii(docs: DataFrame, model: SkipChain) -> DataFrame:
    """``FOUND`` for each row of ``docs``: base counts, the digest of the base spans, all spans and their number.

    Null and empty texts have no spans; repeated rows repeat; other columns are ignored. Places are code points
    of the whole text, ends exclusive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text in b.column(1).to_pylist():
                base = base_spans(text)
                n = [0, 0, 0, 0]
                for k, _, _ in base:
                    n[k] += 1
                spans = model.spans(text, base)
                rows.append((*n, hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(spans), len(spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], names=[x.split()[0] for x in FOUND.split(", ")])

    return doc_text(docs).mapInArrow(run, FOUND)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_pii(docs: DataFrame, model: SkipChain) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced, and ``n_chars``, where there is one, counted anew for a
    text that changed. Null texts stay null; other columns, and all types, stay as they are."""
    bounded_batches(docs.sparkSession)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("pii", lambda: None)
        for b in slices(batches):
            was = b.column(columns.index("text")).to_pylist()
            now = [t if t is None else redact(t, model.spans(t)) for t in was]
            made = {"text": pa.array(now, pa.string())}
            if "n_chars" in columns:
                sizes = b.column(columns.index("n_chars")).to_pylist()
                made["n_chars"] = pa.array([n if t is None or t == x else len(t) for n, t, x in zip(sizes, now, was)], pa.int64())
            yield pa.RecordBatch.from_arrays([made.get(c, b.column(i)) for i, c in enumerate(columns)], names=columns)

    out = docs.withColumn("n_chars", F.col("n_chars").cast("long")) if "n_chars" in columns else docs
    out = out.mapInArrow(run, out.schema)
    return out.withColumn("n_chars", F.col("n_chars").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
