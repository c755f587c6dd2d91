"""Licence scans by sentence rules.

Texts are cut into sentences at blank lines and full stops, so that wrapped
lines stay together.  Sentences are normalised and what they hold of known
licence sentences is mapped to identifiers, in order, and the sequence of a
text's identifiers is matched against licence rules in order: a rule is a
run of identifiers, some of which may be missing, and what a rule has
matched is taken out before the next is tried.  A licence called by its
name, with or without a version, is an identifier that stands for itself,
unless the sentence denies it; an SPDX tag names its licences itself.

All of it is native: identifiers come from ordered replacements in a
sentence, tried only on sentences with a licence word, and rules are ordered
replacements in the joined sequence.

Defined cases: null and empty texts have no sentences and no licence;
identifiers that no rule takes are reported as ``unmatched``; repeated
sentences and licences are kept in order; very long texts are scanned whole;
an empty table gives no rows; rows that are repeated are scanned each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.textcols import text_of

#: Any sentence of interest has one of these; the rest is not looked at.
HINT = (
    r"(?i)licen[cs]|later[\W_]+version|\bas[\W_]+is\b|copyright|permission|permitted|warranty|redistribut|public[\W_]+domain|spdx|rights[\W_]+reserved|liable|endorse|\bcc[\W_]*(?:by|0|zero)|creative[\W_]+commons"
    r"|\b[al]?gpl|\bapache[\W_]*[12]|under[\W_]+(?:the[\W_]+)?(?:mit|expat|isc)\b|\bbsd\b|\bwtfpl|\b(?:mpl|epl|eupl|cddl|gfdl|lppl|ofl)[\W_]*v?[0-9]"
)
#: Marks of comments at the start of a line.
MARK = r"[ \t\r/*#;%>-]"
NOTICE = r"copyright\b(?!\W+(?:notices?|holders?|owners?|statements?|laws?|licen[cs]es?|and|or|in)\b)"
#: Blank lines, stops but those of abbreviated company names, and before a line with a copyright notice.
SENTENCE_END = (
    rf"(?i)\n{MARK}*\n|(?<=[.!?])(?<!\b(?:inc|ltd|corp|co)\.)\s+"
    rf"|(?:\n(?={MARK}*+{NOTICE})|(?<=[;:])[ \t]++(?={NOTICE}))"
)
SPDX_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
SPDX = rf"(?i)SPDX-License-Identifier:[ \t]*(\(*{SPDX_ID}\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*{SPDX_ID}\)*)*)"
#: A version number.
NUMBER = r"\bv?[0-9]+(?:\.[0-9]+)*\b"
#: A licence that is said not to apply.
DENIED = r"\bnot (?:be )?(?:licensed|released|available|distributed|covered|published) (?:under|by) [^,;#]*"

# Licences by their names, in normalised text, and their versions, the first for names without one if
# it ends in a star.  Ordered: a longer name before one it holds.
FAMILIES = (
    ("AGPL", r"(?:gnu )?affero general public license|\bagpl", "3.0"),
    ("LGPL", r"gnu (?:lesser|library) general public license|\blgpl", "3.0 2.1 2.0"),
    ("GFDL", r"gnu free documentation license|\bgfdl", "1.3 1.2 1.1"),
    ("GPL", r"gnu general public license|\bgnu gpl|\bgpl", "3.0 2.0 1.0"),
    ("Apache", r"apache(?: software)? license|\bapache(?= v?[12])", "2.0 1.1 1.0"),
    ("MPL", r"mozilla public license|\bmpl(?= ?v?[12])", "2.0 1.1 1.0"),
    ("EPL", r"eclipse public license|\bepl(?= ?v?[12])", "2.0 1.0"),
    ("EUPL", r"european union public license|\beupl(?= ?v?1)", "1.2 1.1"),
    ("CDDL", r"common development and distribution license|\bcddl(?= ?v?1)", "1.1 1.0"),
    ("CPL", r"common public license", "1.0"),
    ("OSL", r"open software license", "3.0 2.1 2.0 1.0"),
    ("AFL", r"academic free license", "3.0 2.1 2.0 1.2"),
    ("Artistic", r"artistic license", "2.0 1.0"),
    ("BSL", r"boost software license", "1.0*"),
    ("LPPL", r"latex project public license|\blppl(?= ?v?1)", "1.3c 1.3 1.2"),
    ("OFL", r"(?:sil )?open font license|\bofl(?= ?v?1)", "1.1* 1.0"),
    ("PSF", r"python software foundation license", "2.0*"),
    ("ODbL", r"open database license", "1.0*"),
    ("MS-PL", r"microsoft public license", ""),
    ("MS-RL", r"microsoft reciprocal license", ""),
    ("NCSA", r"university of illinois(?:/ncsa)? open source license|\bncsa license", ""),
    ("UPL", r"universal permissive license", "1.0*"),
    ("ECL", r"educational community license", "2.0 1.0"),
    ("Zlib", r"zlib(?:/libpng)? license", ""),
    ("Unlicense", r"\bunlicense\b", ""),
    ("WTFPL", r"\bwtfpl\b|do what the f[^ ]* you want to public license", ""),
    ("PostgreSQL", r"postgresql license", ""),
    ("0BSD", r"\b0bsd|zero clause bsd", ""),
    ("BSD-4-Clause", r"bsd 4 clause|(?:4|four) clause bsd|original bsd license", ""),
    ("BSD-3-Clause", r"bsd 3 clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd license", ""),
    ("BSD-2-Clause", r"bsd 2 clause|(?:2|two) clause bsd|simplified bsd license|freebsd license", ""),
    ("BSD", r"bsd(?: style)? license|under (?:the )?bsd\b", ""),
    ("ISC", r"\bisc license|under (?:the )?isc\b", ""),
    ("MIT", r"\b(?:mit|expat)(?: style)? license|(?:under|and|or|,|/) ?(?:the )?(?:terms of the )?(?:mit|expat)\b", ""),
    ("CC-BY-NC-SA", r"\bcc by nc sa|creative commons attribution non ?commercial share ?alike", ""),
    ("CC-BY-NC-ND", r"\bcc by nc nd|creative commons attribution non ?commercial no ?deriv\w*", ""),
    ("CC-BY-NC", r"\bcc by nc|creative commons attribution non ?commercial", ""),
    ("CC-BY-SA", r"\bcc by sa|creative commons attribution share ?alike", ""),
    ("CC-BY-ND", r"\bcc by nd|creative commons attribution no ?deriv\w*", ""),
    ("CC0", r"\bcc ?0|\bcc zero|creative commons zero", ""),
    ("CC-BY", r"\bcc by\b|creative commons attribution", ""),
    ("Public-Domain", r"(?:in|into|to) the public domain", ""),
)
def between(start: str, end: str) -> str:
    """``start``, anything but an identifier or another start, ``end``."""
    return rf"{start}(?:(?!{start})[^#])*?{end}"


# Sentences of licence texts and notices.  Ordered.
CLAUSES = (
    ("SpdxTag", r"spdx license identifier"),
    ("ApacheCondition", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at"),
    ("AsIsApache", r"distributed on an as is basis"),
    ("GPLSee", r"see the gnu (?:lesser |library |affero )?general public license for more details"),
    ("GPLCopy", r"received a copy of the gnu (?:lesser |library |affero )?general public license"),
    ("FsfNoWarranty", r"without any warranty"),
    ("MITGrant", r"permission is hereby granted, free of charge"),
    ("MITNotice", r"above copyright notice and this permission notice shall be included"),
    ("MITAsIs", r"the software is provided as is ?,? without warranty of any kind"),
    ("BSDGrant", r"redistribution and use in source and binary forms"),
    ("BSDSource", r"redistributions of source code must retain"),
    ("BSDBinary", r"redistributions in binary form must reproduce"),
    ("BSDAdvert", r"all advertising materials mentioning features"),
    ("BSDNoEndorse", between("neither the names? of ", " may be used to endorse")),
    ("BSDAsIs", between("this software is provided by ", " as is")),
    ("ISCGrant", r"permission to use, copy, modify,? and(?:/or)? distribute this software"),
    ("ISCAsIs", r"the software is provided as is and the author disclaims"),
    ("ZlibAsIs", r"this software is provided as is ?,? without any express or implied warranty"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose"),
    ("UnlicenseGrant", r"free and unencumbered software released into the public domain"),
    ("BoostGrant", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
)
LAST = (
    ("OrLater", r"\bany later version|\bor later\b|(?<=# )\+"),
    ("AllRights", r"all rights reserved"),
    ("Copyright", r"^[/ ]*copyright|copyright (?:\(c\)|c\b|\d{4}\b)"),
)


def up_to(name: str) -> str:
    """From a name up to a version number, however far: over no number, no
    other identifier and not over the name again, so that no part of a
    sentence is looked at from more than one name.  A name in brackets after
    a name belongs to it."""
    return rf"(?:{name})(?: ?\((?:{name})\))?(?:(?!{NUMBER}|{name})[^#])*?(?:\bv?|(?<=[gemp]pl)v)"


def version(v: str) -> str:
    """A version as it may be written: 2.0 also as 2."""
    return re.escape(v) if not v.endswith(".0") else rf"{re.escape(v[:-2])}(?:\.0)?(?!\.?[0-9])"


def sentences() -> list[tuple[str, str]]:
    """Ordered: what a pattern matches in a normalised sentence is taken
    before the next is tried."""
    names = []
    for family, name, versions in FAMILIES:
        for v in versions.replace("*", "").split():
            names.append((f"{family}-{v}", rf"{up_to(name)}{version(v)}"))
        names.append((f"{family}-{versions.split()[0][:-1]}" if "*" in versions else family, rf"(?:{name})"))
    first = sorted(CLAUSES, key=lambda c: c[0] != "BoostGrant")
    return [*first, *names, *LAST]


def rules() -> list[tuple[str, tuple[str, ...]]]:
    """Ordered; in a run, what ends in ? may be missing.  A name by itself
    needs no rule."""
    gnu = [f"{f}-{v}" for f, _, vs in FAMILIES if f in ("AGPL", "LGPL", "GPL", "GFDL") for v in vs.split()]
    tail = ("FsfNoWarranty?", "GPLSee?", "GPLCopy?")
    bsd = ("BSDGrant", "BSDSource", "BSDBinary")
    return [
        ("Apache-2.0", ("Apache-2.0", "ApacheCondition", "ApacheCopy?", "Apache-2.0?", "AsIsApache?")),
        ("Apache-2.0", ("ApacheCondition", "ApacheCopy?", "AsIsApache?")),
        ("BSD-4-Clause", (*bsd, "BSDAdvert", "BSDNoEndorse?", "BSDAsIs?")),
        ("BSD-3-Clause", ("BSD-3-Clause?", *bsd, "BSDNoEndorse", "BSDAsIs?")),
        ("BSD-2-Clause", ("BSD-2-Clause?", *bsd, "BSDAsIs?")),
        ("BSD", ("BSD?", "BSDGrant")),
        ("MIT", ("MIT?", "MITGrant", "MITNotice?", "MITAsIs?")),
        ("ISC", ("ISC?", "ISCGrant", "ISCAsIs?")),
        ("Zlib", ("Zlib?", "ZlibAsIs?", "ZlibGrant")),
        ("BSL-1.0", ("BSL-1.0?", "BoostGrant")),
        ("Unlicense", ("Unlicense?", "UnlicenseGrant")),
        *((f"{g}-or-later", (g, "OrLater", *tail)) for g in gnu),
        *((g, (g, *tail)) for g in [*gnu, "GPL"]),
        ("GPL", ("GPLSee", "GPLCopy?")),
        ("GPL", ("GPLCopy",)),
        ("Proprietary", ("AllRights",)),
    ]


def run_pattern(run: tuple[str, ...]) -> str:
    """A run as a pattern over identifiers that have a space on both sides."""
    return "".join(rf"(?: {re.escape(x[:-1])} )?" if x.endswith("?") else rf" {re.escape(x)} " for x in run)


SENTENCES = sentences()
RULES = rules()
NAMED = "|".join(re.escape(name) for name, _ in SENTENCES if name not in dict(CLAUSES) and name not in dict(LAST))


def normalised(sentence: Column) -> Column:
    """One line in lower case, American spelling, punctuation but commas as spaces."""
    plain = F.regexp_replace(F.lower(sentence), rf"\n{MARK}*", " ")
    plain = F.regexp_replace(plain, "licence", "license")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}.,()/+]+", " ")
    plain = F.trim(F.regexp_replace(plain, r"\.(?=\s|$)", ""))
    return F.regexp_replace(plain, DENIED, " ")


def identifiers(sentence: Column) -> Column:
    """What a normalised sentence holds, in order."""
    for name, pattern in SENTENCES:
        sentence = F.regexp_replace(sentence, pattern, f" #{name}# ")
    return F.regexp_extract_all(sentence, F.lit(r"#([\w.-]+)#"), F.lit(1))


def spdx_names(sentence: Column) -> Column:
    """The licences of a sentence that is an SPDX tag, as ``Spdx:`` and the
    name that the rules give them; exceptions are not licences."""
    plain = F.regexp_replace(F.regexp_extract(sentence, SPDX, 1), r"[()]", "")
    plain = F.regexp_replace(plain, rf"(?i)\s+with\s+{SPDX_ID}", "")
    names = F.split(plain, r"(?i)\s+(?:and|or)\s+", -1)

    def named(x: Column) -> Column:
        for pattern, name in ((r"-only$", ""), (r"\+$", "-or-later"), (r"^(CC0|CC-BY[A-Za-z-]*)-[0-9.]+$", "$1")):
            x = F.regexp_replace(x, pattern, name)
        return F.concat(F.lit("Spdx:"), x)

    return F.transform(names, named)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc (the row), sentences (identifiers), licenses, unmatched."""
    t = text_of(text)
    candidates = F.filter(F.split(F.regexp_replace(t, SPDX, "\n\nSPDX-License-Identifier: $1\n\n"), SENTENCE_END, -1), lambda s: s.rlike(HINT))
    ids = F.flatten(F.transform(candidates, lambda s: F.when(s.rlike(SPDX), spdx_names(s)).otherwise(identifiers(normalised(s)))))
    hinted = F.when(t.rlike(HINT), ids).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.struct("*").alias("doc"), hinted.alias("sentences"))
    joined = F.concat(F.lit(" "), F.array_join("sentences", "  "), F.lit(" "))
    for name, run in RULES:
        joined = F.regexp_replace(joined, run_pattern(run), f" ={name} ")
    joined = F.when(F.size("sentences") > 0, F.regexp_replace(joined, f" ({NAMED}) ", " =$1 ")).otherwise(F.lit(""))
    left = F.array_remove(F.split(joined, " +", -1), "")
    taken = lambda x: F.startswith(x, F.lit("=")) | F.startswith(x, F.lit("Spdx:"))
    return rows.select(
        "doc",
        "sentences",
        F.transform(F.filter(left, taken), lambda x: F.regexp_replace(x, "^(?:=|Spdx:)", "")).alias("licenses"),
        F.filter(left, lambda x: ~taken(x)).alias("unmatched"),
    )
