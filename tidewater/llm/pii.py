"""Personal data: fixed patterns, and candidates judged by boosted trees."""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import arrays, boosting
from tidewater.llm.common import packed, table, unpacked

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "ssn")
OUT = ("n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans", "redacted")

#: The base patterns, written so that no position is tried twice and nothing
#: recurses: a run of local-part characters or digits is entered only at its
#: start or where the last match ended, and loops don't give back.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE_PATTERN = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++[.][0-9]++[.][0-9]++[.][0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"[+][0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be looked for.
_GATE = {"email": "contains(%s, '@')", "phone": "contains(%s, '+')"}
_DIGIT = "%s RLIKE '[0-9]'"

#: Code points of context before and after a candidate.
BEFORE, AFTER = 24, 4
#: Generators of candidates: wide patterns, which overlap one another.
CANDIDATES = (
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:[(\[{](?:at|@)[)\]}]| at ) ?[a-z0-9-]{1,63}+(?: ?(?:[.]|[(\[{](?:dot|[.])[)\]}]| dot ) ?[a-z0-9-]{2,63}+)++", "%s RLIKE '(?i)[(\\\\[{](at|@)[)\\\\]}]| at '"),
    ("phone", r"(?<![0-9A-Za-z+.-])(?:00[0-9]{1,3}[ .-]?)?[(]?[0-9]{2,5}[)]?[ .-][0-9]{2,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])", _DIGIT),
    # in pairs, after an area or country code or not; without separators
    ("phone", r"(?<![0-9A-Za-z+.-])(?:00[0-9]{1,3}[ .-]?)?[(]?[0-9]{1,5}[)]?[ ./-]{1,2}[0-9]{2}(?:[ .-]?[0-9]{2}){2,4}(?![0-9A-Za-z])", _DIGIT),
    ("phone", r"(?<![0-9A-Za-z+.-])(?:[(]?0[0-9]{1,4}[)]?[ /-]{1,2})?[0-9]{7,15}+(?![0-9A-Za-z]|[.,][0-9])", _DIGIT),
    ("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", _DIGIT),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){3,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])", "contains(%s, ':')"),
    ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+::(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+)?+|::[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+)(?![0-9A-Za-z:])", "contains(%s, '::')"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _DIGIT),
    ("secret", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+", _DIGIT),
    ("ssn", r"(?<![0-9-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])", _DIGIT),
)


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def find(text: str, pattern: str, gate: str, context: bool = False) -> str:
    """SQL for the leftmost matches of a pattern: an array of (s, start, end) in
    code points, with the text before and after each if context is true. The gaps
    between matches and the matches' lengths give the places."""
    p = _q(pattern)
    kind = "struct<s: string, start: bigint, end: bigint" + (", before: string, after: string>" if context else ">")
    zero = f"CAST(array() AS array<{kind}>)"
    near = ""
    if context:
        # two matches back and one ahead: as far as the context goes
        near = f", 'before', right(concat(coalesce(get(ms, i - 2), ''), coalesce(get(gs, i - 1), ''), coalesce(get(ms, i - 1), ''), gs[i]), {BEFORE}), 'after', left(concat(left(gs[i + 1], {AFTER}), left(coalesce(get(ms, i + 1), ''), {AFTER})), {AFTER})"
    steps = f"transform(ms, (m, i) -> named_struct('m', m, 'gap', length(gs[i]), 'n', length(m){near}))"
    steps = arrays.let("ms", f"regexp_extract_all({text}, {p}, 0)", arrays.let("gs", f"split({text}, {p}, -1)", steps))
    more = ", 'before', x.before, 'after', x.after" if context else ""
    found = arrays.scan(steps, "0L", "c + x.gap + x.n", f"named_struct('s', x.m, 'start', c + x.gap, 'end', c + x.gap + x.n{more})", kind)
    return f"CASE WHEN {gate % text} THEN {found} ELSE {zero} END"


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """SQL: whether a text of digits passes Luhn's test."""
    d = f"CAST(substr({digits}, j, 1) AS INT)"
    doubled = f"CASE WHEN (length({digits}) - j) % 2 = 0 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END"
    return f"(aggregate(transform(sequence(1, greatest(length({digits}), 1)), j -> {doubled}), 0, (a, v) -> a + v) % 10 = 0)"


_VALID = {
    "email": "true",
    # a number over 255 has a digit before its last three other than 0, or its last three are over 255
    "ip": "forall(split(x.s, '[.]'), p -> length(ltrim('0', p)) <= 3 AND CAST(concat('0', ltrim('0', p)) AS INT) <= 255)",
    "card": f"length({_digits('x.s')}) BETWEEN 16 AND 19 AND {luhn(_digits('x.s'))}",
    "phone": f"length({_digits('x.s')}) BETWEEN 8 AND 15",
}


def base_spans(text: str) -> dict[str, str]:
    """SQL for each base kind's matches that hold."""
    return {k: f"filter({find(text, BASE_PATTERN[k], _GATE.get(k, _DIGIT))}, x -> {_VALID[k]})" for k in BASE}


#: Features of a candidate c (kind, s, start, end) with the text before and after.
_CONTEXT = {
    "contact": "(?:write to|tel|phone|call|fax|mobil|mail|contact|whatsapp|reach|sms|appel|ruf)",
    "identity": "(?:ssn|social|iban|account|konto|compte|cuenta|card|visa|carte|karte|tarjeta|passport|credit|bank)",
    "credential": "(?:token|key|secret|passw|pwd|bearer|api|auth|credential)",
    "number": "(?:order|invoice|isbn|version|page|ref|sku|part|model|serial|total|build|commit|sha|hash|md5|lot|year|doi)",
    "network": "(?:ip|ipv6|host|server|addr|from|client)",
}
FEATURES = {
    **{f"is_{k}": f"CAST(c.kind = '{k}' AS INT)" for k in KINDS},
    "length": "length(c.s)",
    "digits": f"length({_digits('c.s')})",
    "letters": "length(regexp_replace(c.s, '[^A-Za-z]', ''))",
    "uppers": "length(regexp_replace(c.s, '[^A-Z]', ''))",
    "gaps": "length(regexp_replace(c.s, '[^ .()-]', ''))",
    "distinct": "size(array_distinct(split(c.s, '')))",
    "hexadecimal": "CAST(c.s RLIKE '^[0-9a-f]+$' AS INT)",
    "luhn": f"CAST(length({_digits('c.s')}) BETWEEN 13 AND 19 AND {luhn(_digits('c.s'))} AS INT)",
    "three_three_four": r"CAST(c.s RLIKE '^[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}$' AS INT)",
    "bracketed": r"CAST(c.s RLIKE '[(\\[{](at|dot|@|[.])[)\\]}]' AS INT)",
    "spaced_dot": "CAST(c.s RLIKE '[.] ' AS INT)",
    "plain_dot": "CAST(c.s RLIKE '[A-Za-z0-9][.][A-Za-z]+$' AS INT)",
    "colons": "length(regexp_replace(c.s, '[^:]', ''))",
    "compressed": "CAST(contains(c.s, '::') AS INT)",
    "national": "CAST(c.s RLIKE '^[(]?0[1-9]' AS INT)",
    "in_pairs": "CAST(c.s RLIKE '([ .-][0-9]{2}){3,}$' AS INT)",
    "before_word": "CAST(c.before RLIKE '[A-Za-z0-9]$' AS INT)",
    "after_word": "CAST(c.after RLIKE '^[A-Za-z0-9]' AS INT)",
    "assigned": r"CAST(c.before RLIKE '[=:] ?[\"\']?$' AS INT)",
    **{f"near_{k}": f"CAST(c.before RLIKE '(?i){v}' AS INT)" for k, v in _CONTEXT.items()},
}
def candidates(text: str) -> str:
    """SQL for all candidates: (kind, s, start, end, before, after)."""
    each = []
    for kind, pattern, gate in CANDIDATES:
        each.append(f"transform({find(text, pattern, gate, context=True)}, x -> named_struct('kind', '{kind}', 's', x.s, 'start', x.start, 'end', x.end, 'before', x.before, 'after', x.after))")
    return f"concat({', '.join(each)})"


#: Labelled candidates that the trees are fitted on, half of them held out.
SAMPLE = 3000
#: The held-out precision that the threshold is calibrated for.
PRECISION = 0.98


def sample(n: int = SAMPLE, seed: int = 7) -> list[tuple[str, str, int]]:
    """(text, what is personal in it or "", 0 or 1): invented sentences, half with
    personal data in a form that the base patterns don't take, half with numbers
    and codes that look like it."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(3, 8)))
    pick = lambda *x: r.choice(x)
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    token = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-") for _ in range(k))

    def amex() -> str:
        s = [3, r.choice((4, 7)), *(r.randrange(10) for _ in range(12))]
        check = sum(x if (15 - 1 - i) % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(s))
        t = "".join(map(str, [*s, -check % 10]))
        return pick(t, f"{t[:4]} {t[4:10]} {t[10:]}")

    yes = (
        lambda: (pick("mail ", "contact ", "write to ", ""), f"{name()}.{name()}{pick('(at)', ' (at) ', '[at]', ' [at] ')}{name()}{pick('(dot)', ' [dot] ', '.')}{pick('com', 'org', 'net')}"),
        lambda: (pick("mail ", "reach me: ", "contact "), f"{name()} at {name()} dot {pick('com', 'org', 'de')}"),
        lambda: (pick("tel ", "call ", "phone: ", "fax ", "mobile ", ""), f"({d(3)}) {d(3)}-{d(4)}"),
        lambda: (pick("tel ", "call ", "phone: ", "tel. ", "sms "), f"{d(3)}{pick('-', '.', ' ')}{d(3)}{pick('-', '.')}{d(4)}"),
        lambda: (pick("tel ", "call ", "appel "), f"00{d(2)} {d(3)} {d(3)} {d(4)}"),
        lambda: (pick("card ", "visa ", "credit card ", "carte "), amex()),
        lambda: (pick("ip ", "from ", "server ", ""), ":".join(hexa(4) for _ in range(8))),
        lambda: (pick("iban ", "konto ", "account ", ""), f"{pick('DE', 'FR', 'ES', 'GB')}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}"),
        lambda: (pick('token = "', 'api_key: ', "secret=", "password: ", 'auth_token = "', "Bearer "), pick(hexa(40), hexa(32), "AKIA" + token(16), token(36), "ghp_" + token(36))),
        lambda: (pick("ssn ", "social security ", "ssn: "), f"{d(3)}-{d(2)}-{d(4)}"),
    )
    def pairs(k: int) -> str:
        sep = pick(" ", " ", ".", "-")
        return sep.join(d(2) for _ in range(k))

    def compressed() -> str:
        head = pick("2001:db8", "fe80", f"2a{hexa(2)}:{hexa(4)}", f"2001:{hexa(3)}:{hexa(4)}", f"fd{hexa(2)}")
        return f"{head}::{pick(d(1), hexa(4), hexa(4) + ':' + hexa(4))}"

    yes += (
        lambda: (pick("mail ", "contact ", "write to ", "reach me: "), f"{name()} at {name()}.{pick('com', 'org', 'net', 'de')}"),
        lambda: (pick("tel ", "appel ", "mobile ", "call ", "phone: ", ""), f"0{r.randint(1, 9)}{(sep := pick(' ', ' ', '.', '-'))}{sep.join(d(2) for _ in range(4))}"),
        lambda: (pick("tel ", "phone: ", "call ", "fax "), f"{pick('0' + d(2) + ' ', '0' + d(3) + '/', '', '00' + d(2) + ' ' + d(1) + ' ')}{pairs(4)}"),
        lambda: (pick("tel ", "call ", "phone: ", "mobile ", "sms ", "whatsapp "), f"{pick('', '0')}{r.randint(2, 9)}{d(pick(8, 9))}"),
        lambda: (pick("ip ", "from ", "server ", "host ", ""), compressed()),
    )

    def not_card() -> str:
        while True:
            t = d(pick(16, 16, 15, 14))
            if sum(int(c) if (len(t) - 1 - i) % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(t)) % 10:
                return pick(t, t, " ".join(t[i : i + 4] for i in range(0, len(t), 4)))

    no = (
        lambda: (pick("", "", "total ", "card ", "visa ", "account "), not_card()),
        lambda: (pick("", "order "), not_card()),
        lambda: (pick("order ", "invoice ", "ref ", "part "), f"{d(3)}-{d(3)}-{d(4)}"),
        lambda: (pick("in ", "pages ", "about ", "total ", "between "), f"{d(3)} {d(3)} {d(3)}"),
        lambda: (pick("isbn ", "sku ", "doi "), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (pick("commit ", "sha ", "hash ", "md5 ", "build "), pick(hexa(40), hexa(32))),
        lambda: ("", f"{name()}-{name()}-{name()}-{name()}2"),
        lambda: ("see ", f"{name()}/{name()}/{name()}/{name()}{d(4)}"),
        lambda: (pick("serial ", "isbn ", "order ", ""), d(13)),
        lambda: (pick("at ", "time ", ""), f"{d(2)}:{d(2)}:{d(2)}:{d(2)}"),
        lambda: (pick("lot ", "model ", ""), f"{pick('AB', 'XY')}{d(2)}{d(4)}{d(4)}{d(4)}"),
        lambda: ("we met ", f"{name()} at {name()} dot {name()}"),
        lambda: ("years ", f"20{d(2)} 20{d(2)}-20{d(2)}"),
        lambda: (pick("", "we met ", "he was ", "she "), f"{name()} at {name()}. {name()}"),
        lambda: (pick("", "see ", "more ", "read it "), f"{name()} at {name()}.{pick('com', 'org', 'net', 'de')}"),
        lambda: (pick("row ", "scores ", "numbers ", "values ", "total ", ""), f"{r.randint(1, 9)}{d(1)} {pairs(pick(3, 4))}"),
        lambda: (pick("on ", "dated ", ""), f"20{d(2)}-{d(2)}-{d(2)} {d(2)}:{d(2)}"),
        lambda: (pick("order ", "total ", "ref ", "serial ", "build ", "version ", ""), f"{r.randint(1, 9)}{d(pick(6, 7, 8, 9, 9))}"),
        lambda: (pick("use ", "in ", ""), f"{pick('add', 'dead', 'bad', 'cafe', 'face', 'fade', 'ace')}::{pick('add', 'bed', 'bad', 'dad', 'feed', 'ee')}"),
    )
    out = []
    for i in range(n):
        good = i % 2 == 0
        lead, what = pick(*(yes if good else no))()
        text = f"{name()} {name()} {lead}{what}{pick(' ', ', ', '. ', chr(34) + ' ')}{name()} {name()}."
        out.append((text, what if good else "", int(good)))
    return out


@lru_cache(maxsize=4)
def _invented(session_id: str, n: int, seed: int, precision: float) -> dict:
    del session_id  # one model a session
    return _fit([(i, *x) for i, x in enumerate(sample(n, seed))], precision)


def _fit(labelled: list[tuple], precision: float) -> dict:
    """Trees, calibration and threshold from rows (number, text, personal part, 1 or
    0); two in four are held out."""
    from pyspark.sql import SparkSession

    rows = SparkSession.getActiveSession().createDataFrame(labelled, "i int, t string, what string, good int")
    found = rows.coalesce(1).selectExpr("i", "t", "what", f"inline({candidates('t')})").selectExpr("i", "instr(t, what) - 1 AS at", "length(what) AS n", "start", "end", f"inline(transform(array(named_struct('kind', kind, 's', s, 'before', before, 'after', after)), c -> named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in FEATURES.items())})))")
    got = np.array([[float(v) for v in row] for row in found.collect()]).reshape(-1, 5 + len(FEATURES))
    if not len(got):
        return {"trees": [], "a": 0.0, "b": 0.0, "cut": 1.0, "precision": 0.0, "recall": 0.0, "brier": 0.0}
    # a candidate is personal if it covers most of what is, and little else
    cover = np.minimum(got[:, 1] + got[:, 2], got[:, 4]) - np.maximum(got[:, 1], got[:, 3])
    y = ((got[:, 2] > 0) & (cover >= 0.8 * np.maximum(got[:, 2], got[:, 4] - got[:, 3]))).astype(float)
    x, held = got[:, 5:], got[:, 0] % 4 >= 2
    trees = boosting.fit(x[~held], y[~held])
    score = boosting.margin(trees, x[held])
    a, b = boosting.calibrate(score, y[held])
    p = 1 / (1 + np.exp(-(a * score + b)))
    order = np.argsort(-p, kind="stable")
    good = np.cumsum(y[held][order]) / np.arange(1, len(order) + 1)
    ok = np.flatnonzero(good >= precision)
    cut = float(round(max(p[order][ok[-1]], 0.5), 4)) if len(ok) else 1.0
    kept = p >= cut
    return {"trees": trees, "a": a, "b": b, "cut": cut, "precision": float(y[held][kept].sum() / max(kept.sum(), 1)), "recall": float(y[held][kept].sum() / max(y[held].sum(), 1)), "brier": float(np.mean((p - y[held]) ** 2)) if len(p) else 0.0}


def model(spark, n: int = SAMPLE, seed: int = 7, precision: float = PRECISION, labelled: DataFrame | None = None) -> dict:
    """The boosted trees, their calibration and threshold. They are fitted on
    `labelled`, if given: rows (text, what: the personal part, empty if there is
    none), of which n are taken, those with the least hash (a bounded sample). If no
    candidate is found in them, or none of those held out is personal, nothing is added
    to the base spans (cut 1, precision and recall 0). Else,
    as there is no labelled personal data in the corpus, once a session on n
    invented texts."""
    if labelled is None:
        return _invented(spark.sparkContext.applicationId, n, seed, precision)
    rows = labelled.select(F.col("text").cast("string"), F.coalesce(F.col("what").cast("string"), F.lit(""))).filter("text IS NOT NULL").toDF("text", "what")
    rows = rows.orderBy(F.xxhash64("text", "what"), "text", "what").limit(n).collect()
    return _fit([(i, r.text, r.what, int(r.what != "")) for i, r in enumerate(rows)], precision)


_ORDER = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"


def find_pii(docs: DataFrame, *, text: str = "text", fitted: dict | None = None) -> DataFrame:
    """All rows of docs with n_email, n_ip, n_card, n_phone (base matches),
    base_spans, spans (arrays of kind, start, end in code points, in order of
    kind and start) and redacted (the text with each span, or run of overlapping
    spans, replaced by its first kind in brackets); input columns of these names
    are replaced.

    Base patterns find what they find. Beyond them, wide patterns propose spans
    that may overlap; boosted trees give each a calibrated probability from its
    form and context; those over the threshold stay unless they overlap a base
    span or a likelier candidate that stays.

    Null text: no spans, and a null redacted text. Empty text: none. Repeated
    rows are treated alike. Very long texts are taken whole, in time that grows
    with length and matches alone. No rows: no rows.
    """
    fitted = fitted or model(docs.sparkSession)
    t = "__t"
    df = packed(docs, OUT, __t=F.coalesce(F.col(text).cast("string"), F.lit("")), __text=F.col(text).cast("string"))
    df = df.selectExpr("*", *[f"{sql} AS __{k}" for k, sql in base_spans(t).items()])
    tag = lambda k: f"transform(__{k}, x -> named_struct('kind', '{k}', 'start', x.start, 'end', x.end))"
    df = df.selectExpr("*", f"concat({', '.join(tag(k) for k in BASE)}) AS base_spans", f"{candidates(t)} AS __all")
    df = df.selectExpr("*", f"CASE WHEN size(base_spans) = 0 OR size(__all) = 0 THEN __all ELSE {_clear('__all', 'base_spans')} END AS __raw")
    names = list(FEATURES)
    vector = f"named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in FEATURES.items())})"
    score = boosting.to_sql(fitted["trees"], [f"f.{k}" for k in names])
    chance = f"1 / (1 + exp(-({fitted['a']!r}D * {score} + {fitted['b']!r}D)))"
    rated = f"transform(__raw, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 'f', {vector}))"
    rated = f"transform({rated}, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 'p', transform(array(c.f), f -> {chance})[0]))"
    df = df.selectExpr("*", f"CASE WHEN size(__raw) = 0 THEN NULL ELSE filter({rated}, c -> c.p >= {fitted['cut']!r}D) END AS __likely")
    by_kind = f"transform(array_sort(transform(%s, x -> named_struct('k', {_ORDER}, 'start', x.start, 'end', x.end, 'kind', x.kind))), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))"
    df = df.selectExpr("*", f"CASE WHEN size(__likely) > 0 THEN {by_kind % f'concat(base_spans, {_chosen("__likely")})'} ELSE base_spans END AS spans")
    # redaction: spans by start; the part of one that an earlier one covers is gone; an empty one at the end brings the rest
    by_start = f"concat(array_sort(transform(spans, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind))), array(named_struct('start', CAST(length({t}) AS BIGINT), 'end', CAST(length({t}) AS BIGINT), 'kind', '')))"
    parts = arrays.scan(by_start, "0L", "greatest(c, x.end)", f"concat({arrays.cut('tb', 'c', 'x.start')}, CASE WHEN x.kind = '' THEN '' ELSE concat('[', upper(x.kind), ']') END)", "string", "x.start >= a.c")
    parts = arrays.let("tb", arrays.text_blocks(t), parts)
    df = df.selectExpr("*", f"CASE WHEN size(spans) > 0 THEN array_join({parts}, '') ELSE __text END AS redacted", *[f"CAST(size(__{k}) AS BIGINT) AS n_{k}" for k in BASE])
    return unpacked(df, docs, OUT)


def _clear(found: str, base: str) -> str:
    """SQL for the candidates that overlap no base span. In order of start, one
    overlaps a span before it if the greatest end so far is behind its start, and
    one after it if the next span's start is before its end."""
    fields = ("kind", "s", "start", "end", "before", "after")
    own = ", ".join(f"'{k}', x.{k}" for k in fields)
    kind = "struct<at: bigint, t: int, kind: string, s: string, start: bigint, end: bigint, before: string, after: string>"
    spans = f"transform({base}, x -> named_struct('at', x.start, 't', 0, 'kind', x.kind, 's', '', 'start', x.start, 'end', x.end, 'before', '', 'after', ''))"
    both = f"array_sort(concat({spans}, transform({found}, x -> named_struct('at', x.start, 't', 1, {own}))))"
    ahead = arrays.scan(both, "0L", "CASE WHEN x.t = 0 THEN greatest(c, x.end) ELSE c END", "x", kind, "x.t = 0 OR a.c <= x.start")
    back = arrays.scan(f"reverse({ahead})", f"{2**63 - 1}L", "CASE WHEN x.t = 0 THEN x.start ELSE c END", "x", kind, "x.t = 1 AND a.c >= x.end")
    return f"transform({back}, x -> named_struct({own}))"


def _chosen(likely: str) -> str:
    """SQL for the candidates that stay: from the likeliest down, one stays unless
    it overlaps one that stays. This is settled in each run of candidates that
    overlap one another."""
    kind = "struct<p: double, start: bigint, back: bigint, kind: string, end: bigint>"
    none = f"CAST(array() AS array<{kind}>)"
    item = "named_struct('p', -x.p, 'start', x.start, 'back', -x.end, 'kind', x.kind, 'end', x.end)"
    last = f"array(named_struct('start', {2**63 - 1}L, 'end', {2**63 - 1}L, 'kind', '', 'p', 0D))"
    by_start = f"concat(array_sort(transform({likely}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'p', x.p))), {last})"
    after = f"CASE WHEN x.start >= c.end THEN named_struct('end', x.end, 'run', array({item})) ELSE named_struct('end', greatest(c.end, x.end), 'run', concat(c.run, array({item}))) END"
    runs = arrays.scan(by_start, f"named_struct('end', 0L, 'run', {none})", after, "c.run", f"array<{kind}>", "x.start >= a.c.end AND size(a.c.run) > 0")
    out = "struct<kind: string, start: bigint, end: bigint>"
    greedy = f"aggregate(array_sort(run), CAST(array() AS array<{out}>), (a, c) -> CASE WHEN exists(a, o -> o.start < c.end AND c.start < o.end) THEN a ELSE concat(a, array(named_struct('kind', c.kind, 'start', c.start, 'end', c.end))) END)"
    return f"flatten(transform({runs}, run -> {greedy}))"


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def op9(spark, sf_dir):
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.selectExpr("doc_id", "n_email", "n_ip", "n_card", "n_phone", f"sha2(CAST({_joined('base_spans')} AS BINARY), 256) AS base_sha256", f"{_joined('spans')} AS spans")
