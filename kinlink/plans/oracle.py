"""DuckDB SQL by which the catalog's queries are checked: common table expressions over the part table."""

from __future__ import annotations

from kinlink.functions.wordlists import COMPANY_WORDS, LEGAL_SUFFIXES, NAME_ABBREVIATIONS, STREET_WORDS
from kinlink.functions.text import CORE_STOP_WORDS
from kinlink.plans.views import GALLERY, S1, TRUTH


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _collapse(e: str) -> str:
    return rf"trim(regexp_replace({e}, '\s+', ' ', 'g'))"


def clean_name(e: str) -> str:
    """One word list entry after the other, three times over."""
    e = f"lower(coalesce({e}, ''))"
    e = rf"regexp_replace({e}, '\([^)]*\)', ' ', 'g')"
    for _ in range(3):
        for s in LEGAL_SUFFIXES:
            e = rf"regexp_replace({e}, '\b{s}\b', ' ', 'g')"
    for a, b in NAME_ABBREVIATIONS:
        e = f"regexp_replace({e}, '{a}', '{b}', 'g')"
    e = f"regexp_replace({e}, '[&''/,.]', ' ', 'g')"
    e = _collapse(rf"regexp_replace({e}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')")
    return _collapse(rf"regexp_replace({e}, '[\p{{L}}\p{{N}}_]*[0-9][\p{{L}}\p{{N}}_]*', '', 'g')")


def clean_address(e: str) -> str:
    e = f"lower(coalesce({e}, ''))"
    for a, b in STREET_WORDS:
        e = rf"regexp_replace({e}, '\b{a}\b', '{b}', 'g')"
    return _collapse(rf"regexp_replace({e}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')")


def words(e: str) -> str:
    return rf"list_filter(string_split_regex(trim({e}), '\s+'), lambda x: x <> '')"


def grams(e: str) -> str:
    bare = f"replace({e}, ' ', '')"
    return f"(case when length({bare}) < 3 then [{bare}] else list_distinct(list_transform(range(1, length({bare}) - 1), lambda i: substr({bare}, i, 3))) end)"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_distinct(list_intersect({a}, {b})))"
    return f"(({both}) / greatest(len(list_distinct({a})) + len(list_distinct({b})) - ({both}), 1))"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, by bits: one step for each letter of b. a may have 120 letters."""
    full = f"((1::hugeint << length({a})) - 1)"
    here = f"coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda i: case when substr({a}, i, 1) = substr({b}, k::integer, 1) then 1::hugeint << (i - 1) else 0::hugeint end)), 0)::hugeint"
    step = f"((v + (v & {here})) | (v - (v & {here}))) & {full}"
    return f"(case when length({a}) = 0 or length({b}) = 0 then 0 else length({a}) - bit_count(list_reduce(range(1, length({b}) + 1)::hugeint[], lambda v, k: {step}, {full})) end)"


def ratio(a: str, b: str) -> str:
    return f"(case when length({a}) + length({b}) = 0 then 1.0 else 2 * {lcs(a, b)} / (length({a}) + length({b})) end)"


_CLEAN = f"entity_id, business_name, business_address, country, {clean_name('business_name')} as n, {clean_address('business_address')} as a, lower(trim(coalesce(country, ''))) as c"

BASE = f"""
with s1 as materialized ({S1.format(part="part")}), gallery as materialized ({GALLERY.format(part="part")}), truth as ({TRUTH.format(part="part")}),
q as materialized (select {_CLEAN} from s1), g as materialized (select {_CLEAN} from gallery),
truth_long as (select source1_entity_id as s1_id, nullif(unnest(string_split(matched_entity_ids, ',')), '') as cand_id from truth)
"""

CORE = (
    "array_to_string(list_filter(" + words("n") + f", lambda t: not list_contains([{', '.join(map(_quoted, CORE_STOP_WORDS))}], t)), ' ')"
)
CORE_KEY = f"(case when length({CORE}) >= 3 then {CORE} || '|' || array_to_string(list_slice({words('a')}, -2, -1), ' ') end)"
INITIALISM = r"(case when regexp_full_match(upper(trim(n)), '\p{L}{2,6}') then upper(trim(n)) else array_to_string(list_transform(regexp_extract_all(n, '[A-Za-z]+'), lambda w: upper(substr(w, 1, 1))), '') end)"
COMPANY = rf"cast(regexp_matches(lower(n), '\b(?:{'|'.join(COMPANY_WORDS)})\b') as integer)"
TOKEN_SORT = f"array_to_string(list_sort({words('lower(n)')}), ' ')"
PINS = r"list_distinct(regexp_extract_all(a, '\b\d{5,6}\b'))"


def soundex(e: str) -> str:
    """American Soundex of a string that begins with a letter: the letter and the codes of the others, equal ones in a row once.

    H and W do not part equal codes, vowels and everything that is no letter do; 7 is the code of a first H or W.
    """
    u = f"upper({e})"
    rest = f"regexp_replace(regexp_replace(substr({u}, 2), '[HW]', '', 'g'), '[^A-Z]', 'A', 'g')"
    codes = f"translate(left({u}, 1) || {rest}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202')"
    for d in "123456":
        codes = f"regexp_replace({codes}, '{d}+', '{d}', 'g')"
    return f"(left({u}, 1) || rpad(left(replace(substr({codes}, 2), '0', ''), 3), 3, '0'))"


def key_join(key: str, leg: str, most: int | None, many: bool = False) -> str:
    """Candidates by a key, as SQL that ends a BASE query."""
    made = f"unnest({key})" if many else key
    cap = f"and k in (select k from gk group by k having count(*) <= {most})" if most else ""
    return f""", qk as (select distinct entity_id as s1_id, {made} as k from q), gk as (select {"distinct" if many else ""} entity_id as cand_id, {made} as k from g)
    select distinct s1_id, cand_id, '{leg}' as leg from qk join gk using (k) where k is not null and k <> '' {cap}"""


SOUNDEX = f"case when regexp_matches(n, '^[A-Za-z]') then {soundex('n')} else '' end"
SHINGLES = grams(r"regexp_replace(lower(n), '[^\p{L}\p{N}_]', '', 'g')")

KEY_LEGS = {
    "soundex": (SOUNDEX, 30, False),
    "prefix": ("case when length(replace(n, ' ', '')) >= 6 then left(replace(n, ' ', ''), 6) end", 30, False),
    "exact": ("n", None, False),
    "address": ("case when length(a) >= 12 then a end", 200, False),
    "name_core": (CORE_KEY, 30, False),
    "pin": (PINS, 30, True),
    "initialism": (INITIALISM, 30, False),
}

#: The candidates by which later steps are checked: equal addresses and equal core keys, with a fixed score.
CANDIDATES = BASE + f""", ka as (select entity_id, case when length(a) >= 12 then a end as k1, {CORE_KEY} as k2 from q),
kg as (select entity_id, case when length(a) >= 12 then a end as k1, {CORE_KEY} as k2 from g),
c1 as (select k1 from kg group by k1 having count(*) <= 200), c2 as (select k2 from kg group by k2 having count(*) <= 30),
cand as materialized (
  select ka.entity_id as s1_id, kg.entity_id as cand_id from ka join kg on ka.k1 = kg.k1 where ka.k1 in (select k1 from c1)
  union select ka.entity_id, kg.entity_id from ka join kg on ka.k2 = kg.k2 where ka.k2 in (select k2 from c2)
), paired as materialized (
  select s1_id, cand_id, x.n as na, y.n as nb, x.a as aa, y.a as ab, x.c as ca, y.c as cb
  from cand join q x on x.entity_id = s1_id join g y on y.entity_id = cand_id
), scored as materialized (
  select s1_id, cand_id, round(({jaccard(words("na"), words("nb"))} + {jaccard(words("aa"), words("ab"))}) / 2, 4) as p from paired
)"""
