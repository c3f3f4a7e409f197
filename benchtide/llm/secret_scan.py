"""Secret scans: fixed patterns, and password guess cost by dynamic programming.

Three kinds of pattern matches are the base (assign, access, hex). The method adds kind "guess": a value in a credential
context (`pwd is ...`, `login: ...`, `bearer ...`) is cut into dictionary words, dates, repeats, keyboard walks and
brute-force spans so that the number of guesses is least; a value whose least cost is GUESSES or more is a secret that
a person wouldn't have put into prose by chance. Every such value is scored, whatever its shape and length, of one character on.

The dictionary is that of two public tokenizers, one of English and one of many languages: their words and word parts in
turn, in the order of their ids, which is about that of their frequency; words that guessers try first, and those that prose
says of a password instead of giving it, stand before them. Letters in
one case (or with one capital in front) that no word covers may be a span of prose, priced letter by letter by how often
the dictionary has a letter after the one before: so length counts, and a value that can be spoken is guessed sooner than
one of random letters, but no sooner than it would be by a guesser who goes by pairs of letters.

The cost is the least over all cuts into these pieces: words; dates; runs of one character; repeats of a piece of at most
UNIT characters; walks over a keyboard; spans of prose and brute-force spans of any length. The programme looks back over UNIT places
and holds, for each place, the cheapest ways with so many pieces that no way with fewer pieces undercuts. Where a run,
walk or repeat goes on, extending it costs less than any other piece there, so only those that begin near its start and
end near its end can be cheapest, which bounds the work on long values.

Defined results: a null or empty text has no spans: zero counts, the digest of the empty string and an empty `spans`.
Positions are code points of the whole text, ends exclusive. Repeated rows give repeated rows. Other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "guess")


def _any_case(words: str) -> str:
    """The letters a-z of a pattern in either case, and no other letter that folds to one."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


ASSIGN = re.compile(_any_case("(?:password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("[0-9a-f]{16,}")
#: Wider contexts than those of the base: what stands before a value that may be a credential.
CONTEXT = re.compile(
    "(?<![A-Za-z0-9])"
    + _any_case(r"(?:passwords?|passwd|passphrase|passcode|pwd|secret|token|credentials?|creds|auth(?:orization)?|bearer|login|(?:api|access|private|secret)[_ -]?key)")
    + r"""["']?(?:[ \t]*(?:[:=]|=>|->)[ \t]*|[ \t]+(?:is|was)[ \t]+|[ \t]+(?=\S*[0-9]))["'`]?([^\s"'`,;<>(){}\[\]]+)"""
)
#: Every match of ASSIGN, and every context, has one of these in its lower-case bytes. Looking for them first is many times faster than the patterns are.
ASSIGN_STEMS = (b"passw", b"secret", b"token", b"api")
CONTEXT_STEMS = (b"passw", b"passphrase", b"passcode", b"pwd", b"secret", b"token", b"cred", b"auth", b"bearer", b"login", b"key")
#: log10 of the guesses from which a value counts as a secret.
GUESSES = 10.0
UNIT = 32
#: log10 of the guesses for a letter of prose that is not one of a-z with or without an accent.
OTHER = math.log10(126)

#: Rows of a keyboard, and words that guessers try first, in that order.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "1qaz2wsx3edc4rfv5tgb6yhn7ujm", "abcdefghijklmnopqrstuvwxyz")
COMMON = (
    "password pass admin root user login welcome secret letmein master monkey dragon sunshine princess football baseball hello freedom whatever trustno shadow superman batman iloveyou test guest default changeme temp demo "
    "love god money summer winter spring autumn monday friday january february march april may june july august september october november december the and you that was for are with his they this have from one had word but not what all were when your can said there use each which she how their will other about out many then them these some her would make like him into time has look two more write see number way could people than first water been call who oil its now find long down day did get come made part"
).split()
#: What prose in four languages says of a password or key instead of giving it.
SAID = (
    "required forbidden mandatory incorrect invalid expired forgotten confidential unnecessary protected encrypted compromised authentication authorization "
    "erforderlich verboten verpflichtend falsch ungültig abgelaufen vergessen geheim vertraulich einverstanden geschützt verschlüsselt gespeichert geändert notwendig zurücksetzen "
    "obligatoire interdit incorrect invalide expiré oublié confidentiel nécessaire protégé chiffré enregistré modifié réinitialiser authentification "
    "obligatoria prohibida incorrecta inválida caducada olvidada confidencial necesaria protegida cifrada almacenada actualizada restablecer autenticación contraseña"
).split()


_LEET = str.maketrans("4@3105$7", "aaeiosst")
_LN10 = math.log(10)
Ways = list[tuple[int, float]]


@lru_cache
def dictionary(path: str | None = None, ranks: str | None = None) -> tuple[str, ...]:
    """COMMON and SAID, then in turn the whole words of a tokenizer's vocabulary and the letters of a rank file's tokens, in the order of their ids. Read where it is used; path and ranks: by default those of the packing and the byte-level operators."""
    import public_tokenizers

    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    with open(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        tokens = [base64.b64decode(line.split()[0]).decode("utf-8", "replace") for line in f]
    whole = [w.removesuffix("</w>") for w in sorted(ids, key=ids.get) if w.endswith("</w>")]
    both = (w for pair in zip_longest(whole, (t.strip().lower() for t in tokens), fillvalue="") for w in pair)
    return tuple(dict.fromkeys([*COMMON, *SAID, *(w for w in both if len(w) >= 3 and w.isalpha())]))


def lowered(s: str) -> str:
    """Lower case, one character for each."""
    low = s.lower()
    return low if len(low) == len(s) else "".join(c.lower() if len(c.lower()) == 1 else c for c in s)


def plainly(c: str) -> str:
    """A letter without its accent."""
    return unicodedata.normalize("NFD", c)[:1]


def cheapest(ways: Ways) -> Ways:
    """The ways (pieces, cost) that no way with as many pieces or fewer undercuts when the factorials count; a further piece then costs that one no more."""
    out: Ways = []
    least = math.inf
    for k, c in sorted(ways):
        if (total := c + math.lgamma(k + 1) / _LN10) < least:
            least = total
            out.append((k, c))
    return out


class Costs:
    """log10 guess costs of pieces, and the cheapest way to cut a value. words: in order of how early they are guessed."""

    def __init__(self, words: tuple[str, ...] = tuple(COMMON)):
        self.rank = {w: k + 1 for k, w in reversed(list(enumerate(words))) if 3 <= len(w) <= UNIT and len(set(w)) > 1}
        self.longest = max(map(len, self.rank), default=0)
        rows = [r for row in KEY_ROWS for r in (row, row[::-1])]
        self.next_key = {(a, b) for r in rows for a, b in zip(r, r[1:], strict=False)}
        letters = "abcdefghijklmnopqrstuvwxyz"
        plain = ["".join(plainly(c) for c in w) for w in self.rank]
        first, pairs = Counter(w[0] for w in plain), Counter(p for w in plain for p in zip(w, w[1:], strict=False))
        before = {a: sum(pairs[a, b] for b in letters) for a in letters}
        self.first = {a: -math.log10((first[a] + 0.5) / (sum(first[x] for x in letters) + 13)) for a in letters}
        self.follow = {(a, b): -math.log10((pairs[a, b] + 0.5) / (before[a] + 13)) for a in letters for b in letters}

    def letter(self, before: str, c: str) -> float:
        """Of a letter of prose after the one before (or none): by the pair without accents, an accent doubles the guesses."""
        a, b = plainly(lowered(before)), plainly(low := lowered(c))
        known = self.follow.get((a, b)) if before else self.first.get(b)
        return (OTHER if known is None else known) + (math.log10(2) if b != low else 0)

    def prose(self, s: str) -> float | None:
        """Of letters in one case or with one capital in front, which costs twice the guesses."""
        if not s.isalpha() or not all(c.islower() for c in s[1:]) and not all(c.isupper() for c in s) or not (s[:1].islower() or s[:1].isupper()):
            return None
        return math.log10(2) * s[0].isupper() + sum(self.letter(a, b) for a, b in zip(["", *s], s, strict=False))

    @staticmethod
    def alphabet(s: str) -> int:
        return max(10, 26 * any("a" <= c <= "z" for c in s) + 26 * any("A" <= c <= "Z" for c in s) + 10 * any("0" <= c <= "9" for c in s) + 33 * any(not c.isalnum() for c in s) + 100 * any(ord(c) > 127 for c in s))

    def word(self, s: str) -> float | None:
        """Of a dictionary word as it is, with signs for letters, or backwards; capitals cost as many guesses as there are ways to place them."""
        low = lowered(s)
        rank = min((self.rank[x] * f for x, f in ((low, 1), (low.translate(_LEET), 2), (low[::-1], 2)) if x in self.rank), default=None)
        if rank is None:
            return None
        upper = sum(c.isupper() for c in s)
        return math.log10(rank * (1 if not upper else 2 if s[0].isupper() and upper == 1 or upper == len(s) else math.comb(len(s), min(upper, len(s) - upper)) + 1))

    @staticmethod
    def date(s: str) -> float | None:
        """Of a year, or of a day, month and year in any order that ends or begins with the year, with one separator or none."""
        if re.fullmatch(r"(?:19|20)[0-9]{2}", s):
            return math.log10(120)
        m = re.fullmatch(r"([0-9]{1,2})([-./]?)([0-9]{1,2})\2((?:19|20)?[0-9]{2})", s) or re.fullmatch(r"((?:19|20)[0-9]{2})([-./]?)([0-9]{1,2})\2([0-9]{1,2})", s)
        if not m:
            return None
        small = sorted((int(m[1]), int(m[3]), int(m[4])))[:2]
        return math.log10(365 * 120 * (4 if m[2] else 1)) if 1 <= small[0] <= 12 and 1 <= small[1] <= 31 else None

    @staticmethod
    def walk(length: int) -> float:
        return math.log10(94 * 4 * length)

    @lru_cache(maxsize=4096)  # noqa: B019  one object lives as long as its worker
    def least(self, s: str) -> float:
        """log10 of the least number of guesses: over all cuts, the product of the pieces' guesses and the factorial of their number."""
        n, low, size = len(s), lowered(s), math.log10(self.alphabet(s))
        plain, back = low.translate(_LEET), low[::-1]
        ways: list[Ways] = [[(0, 0.0)]] + [[] for _ in range(n)]
        walks, same = [0] * (n + 1), [0] * (n + 1)  # how far a walk or a run of one character reaches from here
        for i in range(n - 2, -1, -1):
            walks[i] = walks[i + 1] + 1 if (low[i], low[i + 1]) in self.next_key else 0
            same[i] = same[i + 1] + 1 if s[i] == s[i + 1] else 0
        walked, run = 0, 0  # where the walk and the run that hold this place began
        repeats, began = [0] * (UNIT + 1), [0] * (UNIT + 1)  # characters from here on that equal those a unit later, and where they began to
        span: Ways = []  # brute-force spans that have begun and go on here
        small: Ways = []  # spans of prose that go on with small letters, with capitals, and one capital that small letters may follow
        large: Ways = []
        head: Ways = []

        def offer(i: int, j: int, cost: float) -> None:
            ways[j].extend((k + 1, c + cost) for k, c in ways[i])

        for i in range(n):
            here = ways[i] = cheapest(ways[i])
            offer(i, i + 1, max(size, math.log10(11)))
            ways[i + 1].extend((k + 1, c + size) for k, c in span)
            span = cheapest([(k, c + size) for k, c in [*span, *here]])
            if s[i].isalpha() and s[i].islower():
                on, new = self.letter(s[i - 1], s[i]) if i else 0.0, self.letter("", s[i])
                small, large, head = cheapest([*((k, c + on) for k, c in [*small, *head]), *((k, c + new) for k, c in here)]), [], []
            elif s[i].isalpha() and s[i].isupper():
                on, new = self.letter(s[i - 1], s[i]) if i else 0.0, self.letter("", s[i]) + math.log10(2)
                head = [(k, c + new) for k, c in here]
                small, large = [], cheapest([*((k, c + on) for k, c in large), *head])
            else:
                small, large, head = [], [], []
            ways[i + 1].extend((k + 1, c) for k, c in [*small, *large])
            for j in range(i + 3, min(n, i + self.longest) + 1):
                if low[i:j] in self.rank or plain[i:j] in self.rank or back[n - j : n - i] in self.rank:
                    offer(i, j, self.word(s[i:j]))
            if "0" <= s[i] <= "9":
                for j in range(i + 4, min(n, i + 10) + 1):
                    if (c := self.date(s[i:j])) is not None:
                        offer(i, j, c)
            if i and not walks[i - 1]:
                walked = i
            if i and not same[i - 1]:
                run = i
            if i - walked <= UNIT:
                for j in range(max(i + 3, i + walks[i] + 1 - UNIT), i + walks[i] + 2):
                    offer(i, j, self.walk(j - i))
            if i - run <= UNIT:
                for j in range(max(i + 3, i + same[i] + 1 - UNIT), i + same[i] + 2):
                    offer(i, j, size + math.log10(j - i))
            for unit in range(2, min(UNIT, (n - i) // 2) + 1):  # a repeated piece costs that piece, times how often
                repeats[unit] = max(repeats[unit] - 1, 0)
                if not repeats[unit]:
                    began[unit] = i
                    while i + repeats[unit] + unit < n and s[i + repeats[unit]] == s[i + repeats[unit] + unit]:
                        repeats[unit] += 1
                most = repeats[unit] // unit + 1
                if most < 2 or i - began[unit] > 2 * UNIT:
                    continue
                known = self.word(s[i : i + unit])
                if known is None and (same[i] >= unit - 1 or any(unit % u == 0 and repeats[u] >= unit - u for u in range(2, unit // 2 + 1))):
                    continue  # the piece is itself a repeat, and so cheaper as such
                for times in range(max(2, most - 2 * UNIT // unit - 1), most + 1):
                    offer(i, i + times * unit, min(size * unit, math.inf if known is None else known) + math.log10(times))
        return min(c + math.lgamma(k + 1) / _LN10 for k, c in ways[n])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind): assign and access as whole matches, hex runs; kinds are places in KINDS."""
    low = text.encode().lower()
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12] if any(x in low for x in ASSIGN_STEMS) else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]


def guess_spans(text: str, costs: Costs, least: float = GUESSES) -> list[tuple[int, int, int]]:
    """Values in a credential context that cost 10**least guesses or more."""
    found = []
    low = text.encode().lower()
    if not any(x in low for x in CONTEXT_STEMS):
        return found
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".!?:")
        if value and costs.least(value) >= least:
            found.append((m.start(1), m.start(1) + len(value), 3))
    return found


def text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for a, b, k in spans))


@lru_cache
def costs_of(words: tuple[str, ...] | None, path: str | None) -> Costs:
    """One for each worker process."""
    return Costs(dictionary(path) if words is None else words)


def _scan(words: tuple[str, ...] | None, path: str | None, least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = costs_of(words, path)
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                base = base_spans(text) if text else []
                more = guess_spans(text, costs, least) if text else []
                n = [sum(k == x for _, _, k in base) for x in range(3)]
                rows.append((*n, hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(base + more), len(more)))
            a, b, c, d, e, f = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, pa.int64()) for x in (a, b, c)), pa.array(d, pa.string()), pa.array(e, pa.string()), pa.array(f, pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    return scan


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: tuple[str, ...] | None = None, path: str | None = None, least: float = GUESSES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess of each row. words: the dictionary, by default that of the tokenizer at path. Nothing is shuffled."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scan(words, path, least), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
