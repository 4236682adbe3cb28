"""License scans: sentences become identifiers, ordered rules read the identifier sequence.

Column expressions only. A text is normalised to words and boundaries, known licence sentences are found
between boundaries, wrapped over lines or not; the rules then match runs of identifiers, most specific
rule first, and every rule consumes what it matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The GNU licences besides the general one, by identifier.
GNU = (("LgplUnder", "lesser "), ("LgplUnder", "library "), ("AgplUnder", "affero "))


def _gnu(kind: str) -> tuple[str, ...]:
    """Sentences that put a program under a GNU licence of a kind."""
    terms = f"you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published"
    ends = ("either version # of the license or at your option any later version", "version # of the license")
    begins = ("this program is free software ", "this library is free software ", "")
    long = tuple(f"{b}{terms} by the free software foundation {e}" for b in begins for e in ends)
    return *long, f"licensed under the gnu {kind}general public license version #"


#: The elements of Creative Commons licences by their short names.
CREATIVE = (
    ("CcByNcSa", "attribution noncommercial sharealike", "by nc sa"),
    ("CcByNcNd", "attribution noncommercial noderivatives", "by nc nd"),
    ("CcByNd", "attribution noderivatives", "by nd"),
    ("CcByNc", "attribution noncommercial", "by nc"),
    ("CcBySa", "attribution sharealike", "by sa"),
    ("CcBy", "attribution", "by"),
)


def _creative(elements: str) -> tuple[str, ...]:
    """Sentences that put a work under a Creative Commons licence written out."""
    begins = ("this work is licensed under", "licensed under")
    ends = ("", " international", " unported", " international license", " unported license", " license")
    return tuple(f"{b} {a} creative commons {elements} #{e}" for b in begins for a in ("a", "the") for e in ends)


#: Names in SPDX lines, normalised, with the licence each stands for.
SPDX = (
    ("apache #", "Apache"), ("mit", "MIT"), ("bsd 3 clause", "BSD-3-Clause"), ("bsd 2 clause", "BSD-2-Clause"),
    ("0bsd", "0BSD"), ("isc", "ISC"), ("unlicense", "Unlicense"), ("bsl #", "BSL"), ("mpl #", "MPL"), ("cc0 #", "CC0"),
    ("gpl #", "GPL"), ("gpl # only", "GPL"), ("gpl # or later", "GPL-or-later"),
    ("lgpl #", "LGPL"), ("lgpl # only", "LGPL"), ("lgpl # or later", "LGPL-or-later"),
    ("agpl #", "AGPL"), ("agpl # only", "AGPL"), ("agpl # or later", "AGPL-or-later"),
    ("cc by #", "CC-BY"), ("cc by sa #", "CC-BY-SA"), ("cc by nd #", "CC-BY-ND"), ("cc by nc #", "CC-BY-NC"),
    ("cc by nc sa #", "CC-BY-NC-SA"), ("cc by nc nd #", "CC-BY-NC-ND"),
)

#: Normalised licence sentences (see ``normalised``) by identifier. ``#`` stands for a
#: version number, which is kept beside the identifier, ``*`` for a name of one to twelve words.
SENTENCES = (
    ("CopyrightLine", ("copyright c #", "copyright #")),
    ("AllRights", ("all rights reserved",)),
    ("ApacheUnder", ("licensed under the apache license version #", "licensed under the apache license version # the license")),
    ("ApacheMayNot", ("you may not use this file except in compliance with the license",)),
    ("ApacheObtain", ("you may obtain a copy of the license at",)),
    ("ApacheAsIs", (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed"
        " on an as is basis without warranties or conditions of any kind either express or implied",
    )),
    ("MitUnder", ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license")),
    ("MitGrant", (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation the"
        " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions",
    )),
    ("AsIs", (
        "the software is provided as is without warranty of any kind",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the"
        " warranties of merchantability fitness for a particular purpose and noninfringement",
    )),
    ("GplUnder", (
        "this work is licensed under the gnu general public license version #",
        "licensed under the gnu general public license version #",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation either version # of the license or at your"
        " option any later version",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the"
        " free software foundation either version # of the license or at your option any later version",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation version # of the license",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the"
        " free software foundation version # of the license",
    )),
    ("GplNoWarranty", (
        "this program is distributed in the hope that it will be useful but without any warranty without even the"
        " implied warranty of merchantability or fitness for a particular purpose",
        "* is distributed in the hope that it will be useful but without any warranty without even the implied warranty"
        " of merchantability or fitness for a particular purpose",
    )),
    ("CcByNc", ("licensed under cc by nc #", "this work is licensed under cc by nc #")),
    ("CcBySa", ("licensed under cc by sa #", "this work is licensed under cc by sa #")),
    ("CcBy", ("licensed under cc by #", "this work is licensed under cc by #")),
    ("BsdGrant", (
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met",
    )),
    ("BsdSource", (
        "redistributions of source code must retain the above copyright notice this list of conditions and the"
        " following disclaimer",
    )),
    ("BsdBinary", (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
        " following disclaimer in the documentation and or other materials provided with the distribution",
    )),
    ("BsdEndorse", (
        "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from"
        " this software without specific prior written permission",
    )),
    ("MplUnder", ("this source code form is subject to the terms of the mozilla public license v #",)),
    ("IscGrant", (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies",
    )),
    ("ZeroGrant", (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    )),
    ("BoostUnder", ("distributed under the boost software license version #",)),
    ("BoostGrant", (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and"
        " accompanying documentation covered by this license the software to use reproduce display distribute execute and"
        " transmit the software and to prepare derivative works of the software and to permit third parties to whom the"
        " software is furnished to do so all subject to the following",
    )),
    ("Cc0Waiver", (
        "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to"
        " this software to the public domain worldwide",
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his"
        " or her rights to the work worldwide under copyright law including all related and neighboring rights to the"
        " extent allowed by law",
    )),
    ("UnlicenseRelease", ("this is free and unencumbered software released into the public domain",)),
    *((name, _gnu(kind)) for name, kind in GNU),
    *((name, _creative(elements)) for name, elements, _ in CREATIVE),
    *((name, (f"licensed under cc {short} #", f"this work is licensed under cc {short} #")) for name, _, short in CREATIVE[:3]),
    *((f"Spdx{name}", (f"spdx license identifier {line}",)) for line, name in SPDX),
)

#: Licences and their identifier sequences, tried in this order.
RULES = (
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("Apache", ("ApacheUnder", "ApacheMayNot", "ApacheObtain", "ApacheAsIs")),
    ("Apache", ("ApacheUnder",)),
    ("MIT", ("MitGrant", "AsIs")),
    ("MIT", ("MitGrant",)),
    ("MIT", ("MitUnder",)),
    ("LGPL", ("LgplUnder", "GplNoWarranty")),
    ("LGPL", ("LgplUnder",)),
    ("AGPL", ("AgplUnder", "GplNoWarranty")),
    ("AGPL", ("AgplUnder",)),
    ("GPL", ("GplUnder", "GplNoWarranty")),
    ("GPL", ("GplUnder",)),
    ("CC-BY-NC", ("CcByNc",)),
    ("CC-BY-SA", ("CcBySa",)),
    ("CC-BY", ("CcBy",)),
    ("CC-BY-NC-SA", ("CcByNcSa",)),
    ("CC-BY-NC-ND", ("CcByNcNd",)),
    ("CC-BY-ND", ("CcByNd",)),
    ("MPL", ("MplUnder",)),
    ("ISC", ("IscGrant",)),
    ("0BSD", ("ZeroGrant",)),
    ("BSL", ("BoostUnder",)),
    ("BSL", ("BoostGrant",)),
    ("CC0", ("Cc0Waiver",)),
    ("Unlicense", ("UnlicenseRelease",)),
    *dict.fromkeys((name, (f"Spdx{name}",)) for _, name in SPDX),
    ("AllRightsReserved", ("AllRights",)),
)

VERSION = r"[0-9]+(?:\.[0-9]+)*"
#: A cheap test that every known sentence passes; other texts are not normalised.
HINT = r"(?i)licen[sc]e|copyright|rights|permission|redistribut|warranty|endorse|public\s+domain"

#: What makes the normalised text, in order, on lower-cased text. A carriage return marks an end (blank
#: line, or ``.``, ``!``, ``?`` before white space), a line feed a place where a sentence may begin, end or
#: go on (line break, colon, semicolon, address, number in a list). Comment marks become spaces.
STEPS = (
    (r"\r\n?", "\n"),
    (r"(?m)^[^\p{L}\p{N}\n]*(?:dnl|rem)[ \t]", " "),
    (r"\b(v|ver)\.\s*(?=[0-9])", "$1 "),
    (r"https?://[^\s<>\"')]+", "\n"),
    (r"\n[^\p{L}\p{N}\n]*(?=\n)|[.!?][\"')\]]*(?=\s)", "\r"),
    (r"[:;]|(?<=[0-9])\)", "\n"),
    (r"[^a-z0-9.\r\n]+|(?<![0-9])\.|\.(?![0-9])", " "),
)


def normalised(text: Column) -> Column:
    """Lower-cased ASCII words, version numbers and boundaries (see ``STEPS``)."""
    out = F.lower(text)
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return out


def _pattern(sentence: str) -> str:
    """A name may go on over boundaries (``Some Name, Inc.``) unless the sentence begins with it."""
    out = r"[ \n]+".join(VERSION if w == "#" else w for w in sentence.split(" "))
    out = out.replace(r"[ \n]+*[ \n]+", r"[ \n]+[^ \r\n]+(?:[ \r\n]+[^ \r\n]+){0,11}?[ \r\n]+")
    return r"[^ \r\n]+(?: [^ \r\n]+){0,11}?" + out[1:] if sentence.startswith("*") else out


def known_sentences(text: Column) -> Column:
    """The known sentences of a text in order, as an array of ``identifier version`` (version may be
    empty).

    A sentence stands between two boundaries and may go on over line breaks; of two that begin at one
    place the longer counts.
    """
    every = sorted((s for _, all_ in SENTENCES for s in all_), key=len, reverse=True)
    between = rf"(?<![^\r\n]) *({'|'.join(map(_pattern, every))})(?= *(?:[\r\n]|\z))"
    found = F.regexp_extract_all(normalised(text), F.lit(between), F.lit(1))

    def entry(s: Column) -> Column:
        version = F.regexp_extract(s, rf"(?<=[ \n])({VERSION})(?![a-z0-9])", 1)
        name = lambda i, all_: F.rtrim(F.concat_ws(" ", F.lit(i), version)) if any("#" in x for x in all_) else F.lit(i)
        fits = lambda all_: s.rlike(rf"\A(?:{'|'.join(map(_pattern, all_))})\z")
        return F.coalesce(*[F.when(fits(all_), name(i, all_)) for i, all_ in SENTENCES])

    return F.transform(found, entry)


def apply_rules(sequence: Column) -> Column:
    """Licences read from a sequence of known sentences: rules in order, each on what is left.

    The sequence is one text, ``;A 1;;B ;``, so that a rule is a pattern over whole entries; what it
    matches is replaced by a bar, over which no later rule can reach.
    """
    rest = F.array_join(F.transform(sequence, lambda s: F.concat(F.lit(";"), s, F.lit(";"))), "")
    names = []
    for name, ids in RULES:
        pattern = "".join(f";{i}(?: [^;]*)?;" for i in ids)
        first = f";{ids[0]}(?: ([^;]*))?;" + "".join(f";{i}(?: [^;]*)?;" for i in ids[1:])
        versions = F.regexp_extract_all(rest, F.lit(first), F.lit(1))
        names.append(F.transform(versions, _named(name)))
        rest = F.regexp_replace(rest, pattern, "|")
    return F.array_distinct(F.concat(*names))


def _named(name: str):
    return lambda version: F.rtrim(F.concat_ws(" ", F.lit(name), version))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``docs`` with ``sentences`` (known licence sentences in order, as ``identifier version``) and
    ``licenses`` (licences found, in rule order, each once, as ``name version``); the version is left
    out where the sentence names none. Columns of ``docs`` with these names are replaced.

    Rules are tried in order on the identifier sequence, where unknown sentences do not count; what a
    rule matches is consumed, so a licence's full text is not found again as its short form. Only SPDX lines
    tell ``-or-later`` licences apart. Whole texts are read. Null and empty texts have neither sentences nor licences; rows are independent.
    """
    none = F.array().cast("array<string>")
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = docs.withColumn("sentences", F.when(text.rlike(HINT), known_sentences(text)).otherwise(none))
    some = F.size("sentences") > 0
    return scanned.withColumn("licenses", F.when(some, apply_rules(F.col("sentences"))).otherwise(none))
