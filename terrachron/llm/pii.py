"""Format-preserving pseudonyms: validated numbers, dates and addresses are permuted by a keyed Feistel network.

Only DataFrame functions are used. Each value keeps its kind, length, separators and letter case, and equal values get
equal pseudonyms in every document, however they are spaced. Kinds: card numbers (Luhn), IBANs (mod 97), social
security numbers (valid ranges), IPv4 and IPv6 addresses, calendar dates from 1900 to 2099 (which stay in these years),
phone numbers, e-mail addresses (their local part), long hexadecimal secrets and keys with a well-known prefix. Numbers
that fail their validation are left alone.

Every kind is read into the same form, the numbers (a, b) in [0, ma) x [0, mb) of one or several networks, so that the
plan holds a single network; letters are digits of base 26, figures of base 10, hexadecimal characters of base 16.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOT_IN = "(?<![0-9A-Za-z_])"
NOT_ON = "(?![0-9A-Za-z_])"
HEX4 = "[0-9A-Fa-f]{1,4}"
PREFIX = "(?:A[KS]IA|AIza|gh[opsu]_|sk_live_|rk_live_|sk-|xox[abp]-)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": NOT_IN + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + NOT_ON,
    "secret": NOT_IN + r"(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})" + NOT_ON,
    "token": NOT_IN + PREFIX + r"(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{16,120}" + NOT_ON,
    "date": r"(?<![0-9A-Za-z_./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z_/-]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_-])",
    "phone": r"(?<![0-9A-Za-z_])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}|(?<![.,+-])[2-9][0-8][0-9][2-9][0-9]{6}(?![.,][0-9]))(?![0-9A-Za-z_-])",
    "ip": r"(?<![0-9A-Za-z_.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z_]|\.[0-9])",
    "ipv6": rf"(?<![0-9A-Za-z_:.])(?:(?:{HEX4}:){{7}}{HEX4}|(?=[0-9A-Fa-f:]*[0-9])(?:{HEX4}:){{1,6}}(?::{HEX4}){{1,6}})(?![0-9A-Za-z_:])",
    "card": r"(?<![0-9A-Za-z_])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z_])",
}
#: The country code stays, by the table of calling codes: all digits after it are permuted, however they are spaced.
CALLING = "^[+](1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9][0-9][0-9])"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
ROUNDS = 8
#: Characters of one network at most, so that the numbers of its halves fit a long in every base.
CHUNK = 20
#: The 73049 days from 1900 to 2099 as a product.
DAYS = (17, 4297)
#: The session's setting that holds the key of the queries over the test tables and of the pipeline; else TEST_KEY.
KEY_SETTING, TEST_KEY = "terrachron.pseudonym.key", "not secret: for test tables only"


def session_key(spark: SparkSession) -> str:
    """The key in KEY_SETTING, or TEST_KEY."""
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def _whole(pattern: str) -> str:
    """The pattern of a whole value, as it stands in an SQL literal."""
    return f"^(?:{pattern})$".replace("\\", "\\\\")


class _Sql:
    """SQL text of the parts; lambda variables get a new name each."""

    def __init__(self, key: str) -> None:
        self.key, self.n = hashlib.sha256(key.encode()).hexdigest(), 0

    def var(self, stem: str) -> str:
        self.n += 1
        return f"{stem}{self.n}"

    def let(self, value: str, body) -> str:
        """``body`` with ``value`` computed once."""
        x = self.var("v")
        return f"transform(array({value}), {x} -> {body(x)})[0]"

    def network(self, tweak: str, p: str) -> str:
        """struct(a, b) of ``p`` permuted in [0, p.ma) x [0, p.mb)."""
        s, r = self.var("s"), self.var("r")
        f = lambda x: f"cast(conv(substr(sha2(concat_ws(':', '{self.key}', {tweak}, {p}.ma, {p}.mb, {r}, {x}), 256), 1, 15), 16, 10) as bigint)"
        return (
            f"aggregate(sequence(1, {ROUNDS}), named_struct('a', {p}.a, 'b', {p}.b), ({s}, {r}) -> if({r} % 2 = 1, "
            f"named_struct('a', ({s}.a + {f(f'{s}.b')} % {p}.ma) % {p}.ma, 'b', {s}.b), named_struct('a', {s}.a, 'b', ({s}.b + {f(f'{s}.a')} % {p}.mb) % {p}.mb)))"
        )

    @staticmethod
    def symbols(c: str, k: str) -> str:
        """The characters that may stand for ``c`` in a value of kind ``k``."""
        return f"case when {c} = '' then '-' when {k} in ('secret', 'ipv6') then '0123456789abcdef' when {c} <= '9' then '0123456789' else 'abcdefghijklmnopqrstuvwxyz' end"

    def number(self, s: str, k: str) -> str:
        """struct(v, m): the number that a string of lower-case characters is, and how many there are of its format."""
        t, c = self.var("t"), self.var("c")
        step = self.let(self.symbols(c, k), lambda a: f"named_struct('v', {t}.v * length({a}) + instr({a}, {c}) - 1, 'm', {t}.m * length({a}))")
        return f"aggregate(split({s}, ''), named_struct('v', 0L, 'm', 1L), ({t}, {c}) -> {step})"

    def written(self, s: str, v: str, k: str) -> str:
        """The number ``v`` in the format of the string ``s``."""
        t, c = self.var("t"), self.var("c")
        step = self.let(self.symbols(c, k), lambda a: f"named_struct('v', {t}.v div length({a}), 's', concat(if({c} = '', '', substr({a}, int({t}.v % length({a})) + 1, 1)), {t}.s))")
        return f"aggregate(split(reverse({s}), ''), named_struct('v', {v}, 's', ''), ({t}, {c}) -> {step}).s"

    def luhn(self, digits: str) -> str:
        """The Luhn sum of a digit string, the last digit counted once."""
        c, i, t, x = self.var("c"), self.var("i"), self.var("t"), self.var("x")
        twice = f"if(int({c}) > 4, int({c}) * 2 - 9, int({c}) * 2)"
        return f"aggregate(transform(split(reverse({digits}), ''), ({c}, {i}) -> if({i} % 2 = 1, {twice}, int({c}))), 0, ({t}, {x}) -> {t} + {x})"

    def mod97(self, s: str) -> str:
        t, c = self.var("t"), self.var("c")
        return f"aggregate(split({s}, ''), 0, ({t}, {c}) -> if({c} rlike '[0-9]', ({t} * 10 + int({c})) % 97, ({t} * 100 + ascii({c}) - 55) % 97))"

    def valid(self, k: str, h: str) -> str:
        x = self.var("x")
        plain, area = f"replace({h}, ' ', '')", f"int(left({h}, 3))"
        return (
            f"case {k} when 'card' then {self.luhn(f"regexp_replace({h}, '[^0-9]', '')")} % 10 = 0 "
            f"when 'iban' then length({plain}) between 15 and 34 and {self.mod97(f'concat(substr({plain}, 5), left({plain}, 4))')} = 1 "
            f"when 'ssn' then {area} between 1 and 899 and {area} <> 666 and substr({h}, 5, 2) <> '00' and right({h}, 4) <> '0000' "
            f"when 'ip' then forall(split({h}, '[.]'), {x} -> int({x}) < 256) "
            f"when 'ipv6' then size(filter(split({h}, ':'), {x} -> {x} <> '')) between 3 and if({h} like '%::%', 7, 8) "
            f"when 'date' then {self.form(h)} is not null else true end"
        )

    @staticmethod
    def form(h: str) -> str:
        """The format of a date that exists and lies in 1900 to 2099, or null."""
        year = f"substring({h}, if({h} rlike '^[0-9]{{4}}', 1, 7), 4) between '1900' and '2099'"
        ok = lambda f: f"when try_to_timestamp({h}, '{f}') is not null then '{f}'"
        return f"if({year}, case when {h} like '____-%' then case {ok('yyyy-MM-dd')} end when {h} like '____/%' then case {ok('yyyy/MM/dd')} end when {h} like '%/%' then case {ok('MM/dd/yyyy')} {ok('dd/MM/yyyy')} end else case {ok('dd.MM.yyyy')} end end, null)"

    def parts(self, k: str, h: str, core: str) -> str:
        """Numbers of the networks: array of struct(a, b, ma, mb, l, r); l and r are the strings that a and b are, or empty."""
        q = [f"bigint(split({h}, '[.]')[{i}])" for i in range(4)]
        area = f"if(int(left({h}, 3)) > 666, int(left({h}, 3)) - 2, int(left({h}, 3)) - 1)"  # 001-665, 667-899: 898 of them
        one = lambda a, b, ma, mb: f"array(named_struct('a', bigint({a}), 'b', bigint({b}), 'ma', {ma}L, 'mb', {mb}L, 'l', '', 'r', ''))"
        i, x = self.var("i"), self.var("x")
        per = f"int(greatest(1, ceil(length({core}) / ceil(length({core}) / {CHUNK}))))"
        pieces = f"transform(sequence(0, greatest(length({core}) - 1, 0) div {per}), {i} -> substr({core}, {i} * {per} + 1, {per}))"

        def halves(l: str, r: str) -> str:  # noqa: E741
            return self.let(self.number(l, k), lambda a: self.let(self.number(r, k), lambda b: f"named_struct('a', {a}.v, 'b', {b}.v, 'ma', {a}.m, 'mb', {b}.m, 'l', {l}, 'r', {r})"))

        cut = f"transform({pieces}, {x} -> {halves(f'left({x}, length({x}) div 2)', f'substr({x}, length({x}) div 2 + 1)')})"
        day = self.let(f"datediff(cast(try_to_timestamp({h}, {self.form(h)}) as date), date'1900-01-01')", lambda d: one(f"{d} div {DAYS[1]}", f"{d} % {DAYS[1]}", *DAYS))
        return f"case {k} when 'ssn' then {one(f'{area} * 99 + int(substr({h}, 5, 2)) - 1', f'int(right({h}, 4)) - 1', 898 * 99, 9999)} when 'ip' then {one(f'{q[0]} * 256 + {q[1]}', f'{q[2]} * 256 + {q[3]}', 65536, 65536)} when 'date' then {day} else {cut} end"

    def refill(self, k: str, h: str, seg: str, new: str) -> str:
        """``seg`` with its letters and digits taken from ``new`` in order, capital where it is (hexadecimal: where any is)."""
        c, i = self.var("c"), self.var("i")
        taken = f"substr({new}, length(regexp_replace(left({seg}, {i} + 1), '[^A-Za-z0-9]', '')), 1)"
        raised = f"{c} rlike '[A-Z]' or ({k} in ('secret', 'ipv6') and {h} rlike '[A-F]')"
        return f"array_join(transform(split({seg}, ''), ({c}, {i}) -> if({c} rlike '[A-Za-z0-9]', if({raised}, upper({taken}), {taken}), {c})), '')"

    def made(self, k: str, h: str, seg: str) -> str:
        core, i, p, q = f"lower(regexp_replace({seg}, '[^A-Za-z0-9]', ''))", self.var("i"), self.var("p"), self.var("q")
        moved = f"transform({self.let(core, lambda c: self.parts(k, h, c))}, ({p}, {i}) -> {self.let(self.network(f"{k}, {i}", p), lambda n: f"named_struct('a', {n}.a, 'b', {n}.b, 's', if({k} in ('ssn', 'ip', 'date'), '', concat({self.written(f'{p}.l', f'{n}.a', k)}, {self.written(f'{p}.r', f'{n}.b', k)})))")})"

        def put(m: str) -> str:
            a, b = f"{m}[0].a", f"{m}[0].b"
            joined = f"array_join(transform({m}, {q} -> {q}.s), '')"

            def text(new: str) -> str:
                clean = f"replace({new}, ' ', '')"
                check = f"lpad(cast(98 - {self.mod97(f"concat({clean}, left({h}, 2), '00')")} as string), 2, '0')"
                digit = f"(10 - {self.luhn(f"concat(regexp_replace({new}, '[^0-9]', ''), '0')")} % 10) % 10"
                return f"case {k} when 'iban' then concat(left({h}, 2), {check}, {new}) when 'card' then concat({new}, {digit}) when 'email' then concat({new}, substr({h}, length({seg}) + 1)) else concat(left({h}, length({h}) - length({seg})), {new}) end"

            number = f"if({a} div 99 >= 665, {a} div 99 + 2, {a} div 99 + 1)"
            return (
                f"case {k} when 'ssn' then concat(lpad(cast({number} as string), 3, '0'), '-', lpad(cast({a} % 99 + 1 as string), 2, '0'), '-', lpad(cast({b} + 1 as string), 4, '0')) "
                f"when 'ip' then concat_ws('.', {a} div 256, {a} % 256, {b} div 256, {b} % 256) "
                f"when 'date' then date_format(date_add(date'1900-01-01', int({a} * {DAYS[1]} + {b})), {self.form(h)}) "
                f"else {self.let(self.let(joined, lambda new: self.refill(k, h, seg, new)), text)} end"
            )

        return self.let(moved, put)

    def value(self, h: str) -> str:
        kind = "case " + " ".join(f"when {h} rlike '{_whole(p)}' then '{k}'" for k, p in PATTERNS.items()) + " end"
        seg = lambda k: f"case {k} when 'email' then substring_index({h}, '@', 1) when 'iban' then substr({h}, 5) when 'card' then left({h}, length({h}) - 1) when 'phone' then substr({h}, length(regexp_extract({h}, '{CALLING}', 0)) + 1) when 'token' then substr({h}, length(regexp_extract({h}, '^{PREFIX}', 0)) + 1) else {h} end"
        return self.let(kind, lambda k: f"if({self.valid(k, h)}, {self.let(seg(k), lambda s: self.made(k, h, s))}, {h})")


def pseudonymise(docs: DataFrame, *, key: str, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with the values in ``text`` replaced and, where it has ``n_chars``, that column counted anew.

    ``key`` must be kept secret: whoever has it can invert the pseudonyms (a digest of it stands in the query's plan).
    Rows and columns are kept one to one; no shuffle. Null texts stay null (their ``n_chars`` is kept), empty texts
    stay empty. E-mail addresses whose local part is over 64 characters aren't valid and are left alone.
    """
    if not key:
        raise ValueError("a key is needed")
    sql = _Sql(key)
    t = "`" + text.replace("`", "``") + "`"
    lit = "'" + ANY.replace("\\", "\\\\") + "'"
    h, a, b = sql.var("h"), sql.var("a"), sql.var("b")
    joined = f"array_join(zip_with(split({t}, {lit}, -1), transform(regexp_extract_all({t}, {lit}, 0), {h} -> {sql.value(h)}), ({a}, {b}) -> concat({a}, coalesce({b}, ''))), '')"
    new = F.expr(f"case when {t} rlike '[0-9]|@' then {joined} else {t} end")
    out = docs.withColumn(text, new)
    if n_chars and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.coalesce(F.length(F.col(t)).cast(docs.schema[n_chars].dataType), F.col(n_chars)))
    return out
