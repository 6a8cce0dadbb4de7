"""Invented record tables with known matches, made by a seeded generator on the driver."""

from __future__ import annotations

import random
from pathlib import Path

# Shares of anchors with 0, 1, 2, ... true matches, and of countries.
MATCH_SHARES = (0.0558, 0.0540, 0.1700, 0.2406, 0.2194, 0.1459, 0.0747, 0.0290, 0.0085, 0.0019, 0.00015, 0.00015)
TRAIN_MIX = {"US": 0.60, "India": 0.40}
TEST_MIX = {"US": 0.38, "India": 0.47, "France": 0.15}

SUFFIXES = {"US": ("Inc", "LLC", "Corp", ""), "India": ("Pvt Ltd", "Limited", "LLP", ""), "France": ("SARL", "SAS", "SA", "")}
STREETS = {"US": ("Main Street", "Oak Avenue", "Lake Drive"), "India": ("MG Road", "Park Lane", "Temple Street"), "France": ("Rue Haute", "Place du Lac", "Rue Neuve")}
CITIES = {"US": ("Dover", "Salem", "Austin"), "India": ("Pune", "Delhi", "Kochi"), "France": ("Lyon", "Lille", "Nantes")}
SYLLABLES = ("ka", "ri", "mo", "ven", "tal", "su", "bro", "lin", "dex", "pa", "nor", "qui")


def largest_remainder(n: int, shares: dict) -> dict:
    """n in whole parts by shares; the largest remainders round up, ties by key."""
    total = sum(shares.values())
    exact = {k: n * v / total for k, v in shares.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (-(exact[k] - out[k]), k))[: n - sum(out.values())]:
        out[k] += 1
    return out


def parse_mix(text: str) -> dict[str, float]:
    """A country mix like "US=0.6,India=0.4"."""
    return {k.strip(): float(v) for k, v in (part.split("=") for part in text.split(",") if part.strip())}


def match_counts(n: int, rng: random.Random) -> list[int]:
    counts = largest_remainder(n, dict(enumerate(MATCH_SHARES)))
    out = [k for k, c in counts.items() for _ in range(c)]
    rng.shuffle(out)
    return out


#: Places of letters in the block of a script, all of which have one layout: consonants, and vowels alone and behind a consonant (0: none).
CONSONANTS = {
    "b": 0x2C, "c": 0x1A, "d": 0x26, "f": 0x2B, "g": 0x17, "h": 0x39, "j": 0x1C, "k": 0x15, "l": 0x32, "m": 0x2E, "n": 0x28, "p": 0x2A, "q": 0x15,
    "r": 0x30, "s": 0x38, "t": 0x24, "v": 0x35, "w": 0x35, "x": 0x36, "y": 0x2F, "z": 0x1C,
}
VOWELS = {"a": (0x05, 0), "e": (0x0F, 0x47), "i": (0x07, 0x3F), "o": (0x13, 0x4B), "u": (0x09, 0x41)}
SCRIPTS = {"Devanagari": 0x0900, "Telugu": 0x0C00}
VIRAMA = 0x4D


def to_script(text: str, script: str) -> str:
    """A plain rendering of Latin letters in a script; consonants in a row are joined by a virama."""
    first, out, after = SCRIPTS[script], [], False
    for c in text.lower():
        if c in VOWELS:
            place = VOWELS[c][after]
            out.append(chr(first + place) if place else "")
            after = False
        elif c in CONSONANTS:
            out.append((chr(first + VIRAMA) if after else "") + chr(first + CONSONANTS[c]))
            after = True
        else:
            out.append(c)
            after = False
    return "".join(out)


def noisy_name(name: str, suffixes: tuple[str, ...], rng: random.Random) -> str:
    words, kind = name.split(), rng.random()
    if kind < 0.30 and len(name) > 4:
        k = rng.randrange(1, len(words[0]))
        words[0] = words[0][:k] + words[0][k + 1 :] if len(words[0]) > 3 else words[0]
    elif kind < 0.50 and len(words) > 1:
        words[0], words[1] = words[1], words[0]
    elif kind < 0.65:
        words = " ".join(words).replace(" and ", " & ").split()
    elif kind < 0.75 and len(words) > 2:
        words.pop(rng.randrange(1, len(words)))
    return " ".join(words + ([rng.choice(suffixes)] if rng.random() < 0.7 else [])).strip()


def noisy_address(address: str, rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.25:
        for a, b in (("Street", "St"), ("Avenue", "Ave"), ("Road", "Rd"), ("Drive", "Dr")):
            address = address.replace(a, b)
    elif kind < 0.45:
        address = f"near station, {address}"
    elif kind < 0.60:
        address = address.rsplit(",", 1)[0]
    return address


def shared_names(countries: list[str], share: float, rng: random.Random, fresh) -> list[str]:
    """A name for each anchor: about `share` of a country's anchors stand in clusters of two or three with one name."""
    names = [""] * len(countries)
    for country in sorted(set(countries)):
        mine = [k for k, c in enumerate(countries) if c == country]
        rng.shuffle(mine)
        clustered, at = round(share * len(mine)), 0
        while at < len(mine):
            size = min(rng.randint(2, 3), clustered - at) if clustered - at >= 2 else 1
            name = fresh()
            for k in mine[at : at + size]:
                names[k] = name
            at += size
    return names


def generate(n: int, seed: int = 42, mix: dict | None = None, blank: float = 0.03, shared: float = 0.47, script: float = 0.227, first_id: int = 0, decoys: tuple[float, float, float] = (0.25, 0.15, 0.35)) -> dict[str, list[tuple]]:
    """s1, s2, s3 as (entity_id, business_name, business_address, country) and truth as (s1 id, comma list).

    decoys: for each anchor the chance of a record with its name elsewhere, of one with its address and another name, and of one that has nothing to do
    with any anchor.
    """
    rng = random.Random(seed)
    countries = [c for c, k in largest_remainder(n, mix or TRAIN_MIX).items() for _ in range(k)]
    rng.shuffle(countries)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 3))).title()
    business = lambda: f"{word()} {word()} {rng.choice(('Traders', 'Foods', 'Systems', 'and Sons'))}"
    street = lambda number, country: f"{number} {rng.choice(STREETS[country])}, {rng.choice(CITIES[country])}"
    out: dict[str, list[tuple]] = {"s1": [], "s2": [], "s3": [], "truth": []}
    made = 0

    def record(name: str, address: str, country: str) -> str:
        nonlocal made
        side, made = ("s2" if rng.random() < 0.5 else "s3"), made + 1
        entity = f"{side.upper()}-{500000 + first_id * 10 + made}"
        shown = noisy_name(name, SUFFIXES[country], rng)
        if country == "India" and rng.random() < script:
            shown = to_script(shown, rng.choice(sorted(SCRIPTS)))
        out[side].append((entity, shown, "" if rng.random() < blank else address, country))
        return entity

    names = shared_names(countries, shared, rng, business)
    for k, (country, matches) in enumerate(zip(countries, match_counts(n, rng), strict=True)):
        address, s1 = street(10 + 7 * k, country), f"S1-{100000 + first_id + k}"
        out["s1"].append((s1, f"{names[k]} {rng.choice(SUFFIXES[country])}".strip(), address, country))
        ids = [record(names[k], noisy_address(address, rng), country) for _ in range(matches)]
        out["truth"].append((s1, ",".join(sorted(ids))))
        if rng.random() < decoys[0]:
            record(names[k], street(9000 + made, country), country)
        if rng.random() < decoys[1]:
            record(business(), address, country)
        if rng.random() < decoys[2]:
            record(business(), street(50_000 + made, country), country)
    return out


def write_dataset(folder: str, n_s1: int = 600, seed: int = 42, train_share: float = 0.8) -> None:
    """dataset/train and dataset/test as tab-separated files; the same bytes for the same arguments."""
    n_train = round(n_s1 * train_share)
    parts = {"train": generate(n_train, seed, TRAIN_MIX), "test": generate(n_s1 - n_train, seed + 1, TEST_MIX, first_id=n_train)}
    for split, tables in parts.items():
        base = Path(folder) / "dataset" / split
        base.mkdir(parents=True, exist_ok=True)
        for table, rows in tables.items():
            name = "ground_truth" if table == "truth" else f"source{table[1]}"
            head = ("source1_entity_id", "matched_entity_ids") if table == "truth" else ("entity_id", "business_name", "business_address", "country")
            lines = ["\t".join(r) for r in (head, *rows)]
            (base / f"{split}_{name}.tsv").write_text("\n".join(lines) + "\n", encoding="utf-8")
