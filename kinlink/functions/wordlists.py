"""Fixed values of the normaliser: word lists and replacement tables."""

# Words of legal form and other words dropped from business names, as patterns.
LEGAL_SUFFIXES = (
    "incorporated", r"inc\.?", "corporation", r"corp\.?", "company", r"co\.?", "llc", "llp", "lp", "pllc", "pc",
    "limited", r"ltd\.?", "plc", "pvt", "private", "opc",
    "sarl", "sas", "sasu", "eurl", "snc", "sci", "sa",
    "gmbh", "ag", "kg", "ug", "bv", "nv", "oy", "ab",
    "group", "holdings", "enterprises?", "associates?", "partners?", "the", "and", "laboratory", "lab",
    "dba", "trading as",
)

# Abbreviations in names, applied in this order.
NAME_ABBREVIATIONS = (
    ("&", "and"),
    (r"\bintl\b", "international"),
    (r"\bmfg\b", "manufacturing"),
    (r"\bsvcs?\b", "services"),
    (r"\btechs?\b", "technology"),
    (r"\bmgmt\b", "management"),
    (r"\bgrp\b", "group"),
    (r"\bassocs?\b", "associates"),
    (r"\bsys\b", "systems"),
    (r"\bnorth\b", "n"),
    (r"\bsouth\b", "s"),
    (r"\beast\b", "e"),
    (r"\bwest\b", "w"),
)

# Words of streets and directions, and their short forms.
STREET_WORDS = (
    ("street", "st"), ("avenue", "ave"), ("boulevard", "blvd"), ("drive", "dr"), ("road", "rd"), ("lane", "ln"), ("court", "ct"),
    ("parkway", "pkwy"), ("place", "pl"), ("circle", "cir"), ("north", "n"), ("south", "s"), ("east", "e"), ("west", "w"),
)

# Words that tell a company's name from a person's.
COMPANY_WORDS = (
    "ltd", "inc", "co", "corp", "llc", "plc", "limited", "incorporated", "company", "corporation", "gmbh", "kg", "llp", "pte", "pty",
    "sa", "sarl", "bv", "nv", "ag", "oy", "oyj", "ab", "spa", "srl", "sas", "kft", "ks", "sp", "group", "holdings", "partners",
    "associates", "international", "global", "enterprise", "enterprises",
)

# Letters that no decomposition takes apart.
LIGATURES = {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ß": "ss", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "’": "'"}
