"""Personal information in free text: proposed by patterns, confirmed by validators, weighed by context.

Detection reads a folded copy of the text (one form of width and blanks, no invisible characters, look-alike letters
mapped to Latin, accents dropped) and keeps for each folded character its place in the original, so that the
placeholders replace the original spans and the rest of the text stays as it was.

A span's score starts from its pattern and is raised or lowered by its validators and by the words around it; spans
of at least ``THRESHOLD`` are kept, overlaps go to the earlier kind in ``KINDS``. Checksums decide where a number has one:
16 digits are a citizen number by their date or a payment card by their Luhn digit, an account number needs its mod-97 digits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kataloom.llm.lookalike import mapping

KINDS = ("email", "id_number", "phone", "address", "name", "card", "account")
THRESHOLD = 0.5
#: Name parts up to which the table is collected and sent as a list; beyond, every task reads it from the shared folder.
NAME_PARTS = 200_000

# ---------------------------------------------------------------------------------------------- folding

_folds: dict[str, str] = {}


def _fold_char(c: str) -> str:
    got = _folds.get(c)
    if got is None:
        m = mapping().get(c, c)
        kind = unicodedata.category(m)
        if kind in ("Cf", "Mn", "Me") or m in "͏ᅟᅠㅤﾠ":
            got = ""
        elif kind == "Zs":
            got = " "
        elif kind == "Nd":
            got = str(unicodedata.decimal(m))
        else:
            base = "".join(x for x in unicodedata.normalize("NFKD", m) if unicodedata.category(x) not in ("Mn", "Me"))
            got = base if len(base) == 1 else m
        _folds[c] = got
    return got


def folded(text: str) -> tuple[str, list[int] | None]:
    """The folded text, and for each of its characters the place in ``text`` (None: the same places)."""
    if text.isascii():
        return text, None
    out, at = [], []
    for i, c in enumerate(text):
        f = c if c < "\x80" else _fold_char(c)
        if f:
            out.append(f)
            at.append(i)
    return "".join(out), at


# ---------------------------------------------------------------------------------------------- validators


def luhn(digits: str) -> bool:
    """The check digit of payment cards and the like."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return bool(digits) and total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 mod 97-10, as in bank account numbers (IBAN)."""
    code = re.sub(r"\s", "", code).upper()
    return len(code) > 4 and code.isalnum() and code.isascii() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def citizen_number(digits: str) -> bool:
    """16 digits with a region, a date of birth (women: day + 40) and a serial number."""
    day, month = int(digits[6:8]), int(digits[8:10])
    return len(digits) == 16 and digits[:2] >= "10" and 1 <= (day - 40 if day > 40 else day) <= 31 and 1 <= month <= 12 and digits[12:] != "0000"


def spelled_digits(text: str) -> str:
    """The digits of a run of number words."""
    return "".join(_DIGIT_OF[w] for w in re.findall(r"[a-z]+", text.lower()) if w in _DIGIT_OF)


def _phone_digits(text: str) -> str:
    return re.sub(r"\D", "", text.translate(_LETTERS_AS_DIGITS))


_LETTERS_AS_DIGITS = str.maketrans("OoQlI|", "000111")

# ---------------------------------------------------------------------------------------------- patterns

_DIGIT_WORD = r"(?:nol|kosong|satu|dua|tiga|empat|lima|enam|tujuh|delapan|sembilan)"
_DIGIT_OF = {"nol": "0", "kosong": "0", "satu": "1", "dua": "2", "tiga": "3", "empat": "4", "lima": "5", "enam": "6", "tujuh": "7", "delapan": "8", "sembilan": "9"}
_WORD_DIGITS = re.compile(rf"(?<!\w){_DIGIT_WORD}(?:[\s.,-]+{_DIGIT_WORD}){{7,15}}(?!\w)", re.I)

_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_DOT = r"(?:\s?\.\s?(?=[a-z])|\s*[\[({]\s*(?:dot|titik|\.)\s*[\])}]\s*|\s+(?:dot|titik)\s+)"
_BRACKETED_AT, _WORD_AT = r"[\[({]\s*(?:at|@|a)\s*[\])}]", r"\s(?:at|et)\s"
#: Some part of every address that _EMAIL accepts, and of every span with a digit.
_MAY_BE_EMAIL, _DIGIT = re.compile(rf"@|{_BRACKETED_AT}|{_WORD_AT}", re.I), re.compile(r"\d")
_EMAIL = re.compile(
    rf"(?<![\w.+@-])[a-z0-9_][a-z0-9_.+-]*(?:@|\s+@\s+|\s*{_BRACKETED_AT}\s*|\s*{_WORD_AT}\s*(?=\S+{_DOT}))"
    rf"{_LABEL}(?:(?:\.|{_DOT}){_LABEL})*?(?:\.|{_DOT})[a-z]{{2,}}(?:(?:\.|\s*[\[({{]\s*(?:dot|titik)\s*[\])}}]\s*)[a-z]{{2,}})*",
    re.I,
)

_ID_WORDS = re.compile(r"(?<!\w)(?:nik|ktp|e-?ktp|kk|npwp|pajak|identitas|nomor induk)(?!\w)", re.I)
_CARD_WORDS = re.compile(r"(?<!\w)(?:kartu kredit|kartu debit|visa|mastercard|rekening|norek|no\.? rek|resi|voucher|va|virtual account|invoice|order|pesanan|kode|imei|seri)(?!\w)\W*$", re.I)
_SIXTEEN = re.compile(r"(?<![\w.,/-])(?:\d[ .\-]?){15}\d(?![\w]|[.,/-]\d)")
_TAX = re.compile(r"(?<![\w.,/-])\d{2}[. ]?\d{3}[. ]?\d{3}[. ]?\d[-. ]?\d{3}[. ]?\d{3}(?![\w]|[.,/-]\d)")
_TAX_WORDS = re.compile(r"(?<!\w)(?:npwp|pajak)(?!\w)", re.I)
#: Numbers of payment cards by their length and first digit; account numbers with a country and two check digits.
_CARD = re.compile(r"(?<![\w.,/-])[3-6](?:[ \-]?\d){12,18}(?![\w]|[.,/-]\d)")
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_PASSPORT = re.compile(r"(?<!\w)(?:no(?:mor)?\.?\s*)?(?:paspor|passport|pasport)(?:\s*(?:no|nomor|saya|number|ku))*\W{0,4}([a-z]{1,2}\s?-?\s?\d{6,8})(?!\w)", re.I)

_D = r"[\dOol]"
_MOBILE = re.compile(rf"(?<![\w.,/=@-])(?:\(?\+?\s?6\s?2\)?[\s.\-]{{0,3}}(?:\(0\))?|[0Oo][\s.\-]?)8(?:[\s.\-]{{0,2}}{_D}){{7,12}}(?!\w)|(?<![\w/=@-])\([0Oo]8{_D}{{1,2}}\)(?:[\s.\-]{{0,2}}{_D}){{5,10}}(?!\w)")
_LANDLINE = re.compile(r"(?<![\w.,/=-])(?:\(0[2-7]\d{1,2}\)|\+?62[\s.-]?\(?[2-7]\d{1,2}\)?|0[2-7]\d{1,2}[\s-])\s?\d{3,4}[\s.\-]?\d{3,4}(?!\w)")
_NOT_PHONE = re.compile(r"(?<!\w)(?:resi|jx|versi|error|voucher|kode pos|rp|musim|skor)\W*$", re.I)

_STREET = r"(?:jalan|jln|jl|gang|gg|lorong|lr|komplek|kompleks|komp|perumahan|perum|griya|dusun|dsn|kampung|kp|dukuh|blok|ruko|apartemen)"
_NUMBER = r"(?:(?:no|nomor|nmr|nr|rt|rw|blok|blk|kav|kavling|km|unit|lantai|lt)(?:\s*[.:/]?\s*)(?:[a-z]{1,2}[\s./-]?)?\d|blok\s+[a-z]\d*\s+(?:no|nomor)\W*\d)"
_ADDRESS = re.compile(
    rf"(?<![\w-]){_STREET}(?![\w-])\.?\s+(?!tol(?!\w)|terus(?!\w))(?P<name>(?:[^\W\d_][\w'-]*[.,]?\s+){{1,5}}?)(?P<number>\d{{1,3}}[a-z]?\s*[,/]?\s*(?:{_NUMBER}[\w.]*(?:/\d\w*)*)|{_NUMBER}[\w.-]*(?:/\d\w*)*)"
    rf"(?:\s*[,/]?\s*(?:rt|rw|no|nomor|blok)\W{{0,2}}\d+[\w./]*)*(?:,?\s+(?:kec|kel|desa|kab|kota)\.?\s+[^\W\d_]+)*(?:,?\s+(?:[^\W\d_]+\s+)?(?:kode\s+pos\s+)?\d{{5}}(?!\d))?",
    re.I,
)
_ADDRESS_BARE = re.compile(r"(?<![\w-])(?:jl|jln|gg|jalan|gang)(?![\w-])\.?\s+(?!tol(?!\w)|terus(?!\w))[A-Z][\w'-]*(?:\s+[A-Z][\w'-]*){0,3}\s+(?:\d{1,3}[A-Za-z]?)(?=\s*(?:[,.;]|$))")

_WORD = r"[^\W\d_]+(?:['’][^\W\d_]+)?"
_HONORIFIC = r"(?:bapak|pak|bpk|ibu|bu|mas|mbak|mba|kak|kakak|bang|abang|om|tante|sdr|sdri|saudara|saudari|tuan|nyonya|ny|tn|dr|dokter|ustadz|ustad|haji|hj)"
_INTRODUCED = (
    r"(?:nama\s*(?:lengkap|saya|gue|gw|aku|ku|dia)?\s*[:=]|nama\s+(?:saya|gue|gw|aku|lengkap)(?:\s+adalah)?|namaku|atas\s+nama|a\.?\s?n\.?|"
    r"kenalin\s+(?:gue|gw|saya|aku)|perkenalkan\s+(?:saya|aku)|salam\s+dari|ttd|tertanda|cari\s+alumni|alumni|kontak|cp|hubungi)"
)
_NAMED = re.compile(rf"(?<![\w@#.])(?P<cue>{_INTRODUCED}|{_HONORIFIC}\.?|--+|~)[\s:=]+(?P<words>{_WORD}(?:[ .,]{{1,2}}{_WORD}){{0,3}})", re.I)
_WORDS = re.compile(_WORD)
_LONELY = re.compile(rf"(?<![\w@#.+]){_WORD}(?:,? (?:[^\W\d_]\. ?)?{_WORD})+")


class NameModel:
    """Which words can be part of a personal name: the known parts, and words built like them.

    A part counts as built if it splits into a beginning and an ending that each occur in at least ``support``
    known parts; parts that are everyday words (they stand in ``everyday``) need a cue and a capital letter.
    """

    def __init__(self, parts: list[str], everyday: set[str] | None = None, support: int = 3) -> None:
        self.parts = {p.lower() for p in parts if p}
        heads: dict[str, int] = {}
        tails: dict[str, int] = {}
        for p in self.parts:
            for k in range(2, len(p) - 2):
                heads[p[:k]] = heads.get(p[:k], 0) + 1
                tails[p[k:]] = tails.get(p[k:], 0) + 1
        self.heads = {h for h, n in heads.items() if n >= support}
        self.tails = {t for t, n in tails.items() if n >= support and len(t) >= 3}
        self.loose_heads = {h for h, n in heads.items() if n >= 2}
        self.loose_tails = {t for t in tails if len(t) >= 3}
        # Known parts that share no beginning-and-ending with other parts are taken for everyday words.
        built = {p for p in self.parts if any(heads.get(p[:k], 0) >= 2 and tails.get(p[k:], 0) >= 2 for k in range(2, len(p) - 2))}
        self.everyday = (everyday or set()) | (self.parts - built)
        self.seen: dict[str, int] = {}

    def _built(self, word: str) -> bool:
        return any(word[:k] in self.heads and word[k:] in self.tails for k in range(2, len(word) - 2))

    def plausible(self, word: str) -> bool:
        """Built like a name part by a looser measure; only for capitalised words after a cue."""
        w = word.lower()
        return any(w[:k] in self.loose_heads and w[k:] in self.loose_tails for k in range(2, len(w) - 2))

    def level(self, word: str) -> int:
        """2: a name part that is no everyday word, or built like one; 1: an everyday word that is also a name; 0: none."""
        w = word.lower()
        got = self.seen.get(w)
        if got is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            got = self.seen[w] = 1 if w in self.parts and w in self.everyday else 2 if w in self.parts or self._built(w) else 0
        return got


def _names(text: str, model: NameModel) -> Iterator[tuple[int, int, float]]:
    for m in _NAMED.finditer(text):
        cue = m["cue"].lower()
        address = re.fullmatch(_HONORIFIC + r"\.?", cue) is not None
        labelled = "nama" in cue and cue[-1] in ":="
        run: list[tuple[re.Match[str], int]] = []
        for w in _WORDS.finditer(text, m.start("words"), m.end("words")):
            level, capital = model.level(w[0]), w[0][0].isupper()
            gap = text[run[-1][0].end() : w.start()] if run else ""
            if "." in gap and len(run[-1][0][0]) > 1:
                break
            if level == 0 and len(w[0]) == 1 and capital and run:
                run.append((w, 0))
            elif level == 2 or (level == 1 and (capital or run)):
                run.append((w, level))
            elif run and not address and run[-1][1] == 2 and len(w[0]) > 4 and model.plausible(w[0]):
                run.append((w, 1))
            elif capital and len(w[0]) > 2 and len([x for x in run if x[1] >= 0]) < 3:
                run.append((w, 1 if model.plausible(w[0]) else -1))
            else:
                break
        strong = any(x == 2 for _, x in run)
        # Capitalised words of no known shape stay if a label asks for a name, or a known part follows or precedes.
        while run and not labelled and run[-1][1] == -1:
            run.pop()
        while run and run[-1][1] == 0:
            run.pop()
        if run and not labelled and not strong and any(x == -1 for _, x in run):
            run = []
        if run:
            words = sum(len(w[0]) > 1 for w, _ in run)
            score = 0.9 if strong else 0.75 if words > 1 else 0.6
            if cue in ("hubungi", "kontak", "cp") and not strong:
                score -= 0.4
            if not address and words < 2 and not (labelled or strong):
                score -= 0.3
            yield run[0][0].start(), run[-1][0].end(), score
    for m in _LONELY.finditer(text):
        run: list[re.Match[str]] = []
        for w in [*_WORDS.finditer(text, m.start(), m.end()), None]:
            if w is not None and (model.level(w[0]) == 2 or (run and len(w[0]) == 1 and w[0].isupper()) or (model.level(w[0]) == 1 and w[0][0].isupper())):
                run.append(w)
                continue
            strong = [x for x in run if model.level(x[0]) == 2]
            full = [x for x in run if len(x[0]) > 1]
            if len(full) >= 2 and strong:
                capital = sum(x[0][0].isupper() for x in full)
                known = sum(x[0].lower() in model.parts for x in full)
                score = 0.3 + 0.15 * (capital == len(full)) + 0.15 * known
                yield run[0].start(), run[-1].end(), score
            run = []


def find(text: str, model: NameModel) -> list[tuple[int, int, str, float]]:
    """Spans (start, end, kind, score) of the text, in the text's own places, ascending and without overlaps."""
    t, at = folded(text)
    found: list[tuple[int, int, str, float]] = []

    def free(s: int, e: int) -> bool:
        return all(e <= a or s >= b for a, b, _, _ in found)

    def propose(s: int, e: int, kind: str, score: float) -> None:
        if score >= THRESHOLD and free(s, e):
            found.append((s, e, kind, score))

    has_digit = _DIGIT.search(t) is not None
    if _MAY_BE_EMAIL.search(t):
        for m in _EMAIL.finditer(t):
            propose(m.start(), m.end(), "email", 0.9)
    if has_digit:
        for m in _PASSPORT.finditer(t):
            propose(m.start(1), m.end(1), "id_number", 0.9)
        for m in _SIXTEEN.finditer(t):
            digits, before = re.sub(r"\D", "", m[0]), t[max(0, m.start() - 25) : m.start()]
            score = 0.6 if citizen_number(digits) else 0.1
            score += 0.3 * bool(_ID_WORDS.search(before)) - 0.6 * bool(_CARD_WORDS.search(before))
            propose(m.start(), m.end(), "id_number", score)
        for m in _TAX.finditer(t):
            before = t[max(0, m.start() - 25) : m.start()]
            shaped = re.fullmatch(r"\d\d\.\d{3}\.\d{3}\.\d-\d{3}\.\d{3}", m[0]) is not None
            propose(m.start(), m.end(), "id_number", 0.6 * shaped + 0.6 * bool(_TAX_WORDS.search(before)))
        for m in _MOBILE.finditer(t):
            n = len(_phone_digits(m[0]))
            before = t[max(0, m.start() - 12) : m.start()]
            score = 0.8 if 9 <= n <= 15 and sum(c.isdigit() for c in m[0]) >= 5 else 0.2
            propose(m.start(), m.end(), "phone", score - 0.6 * bool(_NOT_PHONE.search(before)))
        for m in _LANDLINE.finditer(t):
            before = t[max(0, m.start() - 12) : m.start()]
            propose(m.start(), m.end(), "phone", 0.7 - 0.6 * bool(_NOT_PHONE.search(before)))
        for m in _ADDRESS.finditer(t):
            propose(m.start(), m.end(), "address", 0.8)
        for m in _ADDRESS_BARE.finditer(t):
            propose(m.start(), m.end(), "address", 0.6)
    for m in _WORD_DIGITS.finditer(t):
        # Spelled out, a number is one to call if it begins as one; counting from one to ten isn't.
        propose(m.start(), m.end(), "phone", 0.8 if re.match(r"0[2-9]|62", spelled_digits(m[0])) else 0.3)
    for s, e, score in _names(t, model):
        propose(s, e, "name", score)
    if has_digit:
        for m in _CARD.finditer(t):
            before = t[max(0, m.start() - 25) : m.start()]
            score = 0.6 * luhn(re.sub(r"\D", "", m[0])) + 0.3 * bool(_CARD_WORDS.search(before)) - 0.3 * bool(_ID_WORDS.search(before))
            propose(m.start(), m.end(), "card", score)
        for m in _ACCOUNT.finditer(t):
            before = t[max(0, m.start() - 12) : m.start()]
            propose(m.start(), m.end(), "account", 0.9 * mod97(m[0]) - 0.6 * bool(_NOT_PHONE.search(before)))
    found.sort()
    if at is None:
        return found
    return [(at[s], at[e - 1] + 1, k, x) for s, e, k, x in found]


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    out, last = [], 0
    for s, e, kind, _ in spans:
        out += [text[last:s], f"[{kind.upper()}]"]
        last = e
    return "".join([*out, text[last:]])


def _runner(parts: list[str], everyday: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = NameModel(parts, set(everyday))
        for batch in batches:
            texts, kinds, counts = [], [], []
            for text in batch.column("text").to_pylist():
                spans = find(text, model) if text else []
                texts.append(redact(text, spans) if spans else text)
                here = [k for k in KINDS if any(k == x[2] for x in spans)] if spans else []
                kinds.append(here)
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(counts, pa.int64())],
                names=["id", "text_redacted", "kinds", "spans"],
            )

    return run


def redact_personal_information(comments: DataFrame, id_col: str, text_col: str, names: DataFrame, name_col: str = "name_part", everyday: list[str] | None = None) -> DataFrame:
    """(id, text_redacted, kinds, spans): every text with its personal information replaced by typed placeholders.

    Placeholders are [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS], [NAME], [CARD] and [ACCOUNT]; ``kinds`` lists the kinds found,
    ``spans`` counts the replacements. Null texts stay null and empty ones empty, with no kinds; null ids are kept; other
    columns are dropped. ``names`` is the table of known name parts, a dictionary that is sent to the executors
    after a check of its size (at most NAME_PARTS rows). No shuffle takes place.
    """
    parts = [r[0] for r in names.select(name_col).where(F.col(name_col).isNotNull()).limit(NAME_PARTS + 1).collect()]
    if len(parts) > NAME_PARTS:
        raise ValueError(f"more than {NAME_PARTS} name parts")
    rows = comments.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_runner(sorted(parts), sorted(everyday or [])), "id bigint, text_redacted string, kinds array<string>, spans bigint")
