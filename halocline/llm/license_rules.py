"""License detection: ordered signature rules, a keyword prefilter, and suppression of covered finds.

Texts are reduced to their words (ASCII lower case, words as in ``LICENSE_WORD``) joined by one blank.
A rule is a regular expression over that form, with a keyword that must be there before the expression
is tried, a label, a confidence and a priority (its place in the order, lower first). A find covered by a
longer one, or by an equal one of a rule that comes first, is suppressed. All is built-in functions.
"""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Families: label, a keyword that every form holds as a whole word, the name as an expression, the tag form or None.
#: A name or tag that has no word in common with the others is a family of its own.
FAMILIES = (
    ("mit", "mit", r"mit|mit x11|x11 mit", r"mit(?: 0)?"),
    ("mit", "expat", r"expat", None),
    ("apache", "apache", r"apache(?: software)?", r"apache(?: [12](?: [01])?)?"),
    ("gpl", "gpl", r"gnu gpl|gpl(?: [123])?", r"gpl [123](?: 0)?(?: only| or later)?"),
    *[("gpl", f"gplv{v}", rf"gplv{v}(?: [123])?", None) for v in (1, 2, 3)],
    ("gpl", "general", r"(?:gnu )?general public", r"gnu general public license v[123]"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: [23](?: [01])?)?", r"lgpl [23](?: [01])?(?: only| or later)?"),
    *[("lgpl", f"lgplv{v}", rf"(?:gnu )?lgplv{v}(?: [23](?: [01])?)?", None) for v in (2, 3)],
    ("lgpl", "lesser", r"(?:gnu )?lesser general public", r"gnu lesser general public license"),
    ("lgpl", "library", r"(?:gnu )?library general public", r"gnu library general public license"),
    ("agpl", "agpl", r"(?:gnu )?agpl(?: 3)?", r"agpl 3(?: 0)?(?: only| or later)?"),
    ("agpl", "agplv3", r"(?:gnu )?agplv3(?: 3)?", None),
    ("agpl", "affero", r"(?:gnu )?affero general public", r"gnu affero general public license"),
    ("bsd", "bsd", r"(?:new |simplified |modified |revised )?bsd(?: style)?(?: [0234] clause)?|[0234] clause bsd", r"bsd [0234] clause"),
    ("bsd", "freebsd", r"freebsd(?: documentation)?", r"freebsd"),
    ("mpl", "mozilla", r"mozilla public", r"mozilla public license"),
    ("mpl", "mpl", r"mpl(?: [12](?: [01])?)?", r"mpl [12](?: [01])?"),
    ("epl", "eclipse", r"eclipse public", r"eclipse public license"),
    ("epl", "epl", r"epl(?: [12](?: 0)?)?", r"epl [12](?: 0)?"),
    ("cddl", "cddl", r"cddl(?: 1(?: [01])?)?", r"cddl 1(?: [01])?"),
    ("cddl", "distribution", r"common development and distribution", r"common development and distribution license"),
    ("cpl", "common", r"common public", None),
    ("cpl", "cpl", None, r"cpl 1(?: 0)?"),
    ("isc", "isc", r"isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?", r"zlib"),
    ("libpng", "libpng", r"libpng", r"libpng(?: 2 0)?"),
    ("boost", "boost", r"boost(?: software)?", r"boost software license"),
    ("boost", "bsl", r"bsl(?: 1(?: 0)?)?", r"bsl 1(?: 0)?"),
    ("artistic", "artistic", r"(?:perl )?artistic(?: [12](?: 0)?)?", r"artistic [12](?: 0)?"),
    ("unlicense", "unlicense", r"unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl"),
    ("cc0", "cc0", r"cc0(?: 1(?: 0)?)?", r"cc0 1(?: 0)?"),
    ("cc0", "zero", r"creative commons zero", r"creative commons zero"),
    ("cc-by", "commons", r"creative commons attribution(?: [1234](?: 0)?)?", r"creative commons attribution"),
    ("cc-by-sa", "alike", r"creative commons attribution share alike(?: [1234](?: 0)?)?", r"cc by share alike"),
    ("cc-by-sa", "sharealike", r"creative commons attribution sharealike(?: [1234](?: 0)?)?", None),
    ("cc-by-nc", "noncommercial", r"creative commons attribution noncommercial(?: [1234](?: 0)?)?", r"cc by noncommercial"),
    ("cc-by-nd", "noderivatives", r"creative commons attribution noderivatives(?: [1234](?: 0)?)?", r"cc by noderivatives"),
    ("cc-by", "cc", r"cc by(?: [1234](?: 0)?)?", r"cc by [1234](?: 0)?"),
    ("cc-by-sa", "sa", r"cc by sa(?: [1234](?: 0)?)?", r"cc by sa [1234](?: 0)?"),
    ("cc-by-nc", "nc", r"cc by nc(?: [1234](?: 0)?)?", r"cc by nc [1234](?: 0)?"),
    ("cc-by-nd", "nd", r"cc by nd(?: [1234](?: 0)?)?", r"cc by nd [1234](?: 0)?"),
    ("ofl", "ofl", r"(?:sil )?ofl(?: 1(?: [01])?)?", r"ofl 1(?: [01])?"),
    ("ofl", "font", r"(?:sil )?open font", r"sil open font license"),
    ("python", "python", r"python(?: software foundation)?", r"python 2(?: 0)?"),
    ("psf", "psf", r"psf(?: 2(?: 0)?)?", r"psf 2(?: 0)?"),
    ("ruby", "ruby", r"ruby", r"ruby"),
    ("php", "php", r"php(?: 3(?: 0)?)?", r"php 3(?: 0)?"),
    ("ms-pl", "microsoft", r"microsoft public", r"microsoft public license"),
    ("ms-rl", "reciprocal", r"microsoft reciprocal", None),
    ("ms-rl", "rl", None, r"ms rl"),
    ("eupl", "eupl", r"eupl(?: 1(?: [012])?)?", r"eupl 1(?: [012])?"),
    ("eupl", "union", r"european union public", r"european union public licence"),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: [12])?", r"cecill [12](?: [01])?"),
    ("openssl", "openssl", r"openssl", r"openssl"),
    ("openssl", "ssleay", r"ssleay", None),
    ("postgresql", "postgresql", r"postgresql", r"postgresql"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)?", r"w3c"),
    ("x11", "x11", r"x11", r"x11"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", r"ncsa"),
    ("upl", "universal", r"universal permissive", None),
    ("upl", "upl", None, r"upl 1(?: 0)?"),
    ("vim", "vim", r"vim", r"vim"),
    ("beerware", "beerware", r"beerware", r"beerware"),
    ("beerware", "beer", r"beer ware", None),
    ("gfdl", "documentation", r"(?:gnu )?free documentation", r"gnu free documentation license"),
    ("odbl", "database", r"open(?: data commons)? database", None),
    ("odbl", "odbl", None, r"odbl 1(?: 0)?"),
    ("sspl", "sspl", r"sspl(?: v?1)?", r"sspl 1(?: 0)?"),
    ("elastic", "elastic", r"elastic(?: 2(?: 0)?)?", r"elastic 2(?: 0)?"),
    ("busl", "business", r"business source", None),
    ("busl", "busl", None, r"busl 1(?: 1)?"),
)
_LICENSE = r"licen[sc]e"
_VERSION = r"(?: (?:v|ver|version|v?\d)(?: \d+)*)?"
#: Forms of a family, the surest first: expression around the name {n} or tag {t}, confidence.
FORMS = (
    (r"spdx licen[sc]e identifier {t}", 1.0),
    (r"(?:re|dual)?licensed (?:under|by|with)(?: the)?(?: terms of(?: the)?)? (?:{n})(?: " + _LICENSE + r")?" + _VERSION, 0.95),
    (r"(?:(?:released|distributed|available|published|provided|covered) )?(?:under|by|see)(?: the)?(?: terms (?:and conditions )?of(?: the)?)? (?:{n}) " + _LICENSE + _VERSION, 0.9),
    (r"(?:the )?(?:{n}) " + _LICENSE + _VERSION, 0.85),
    (_LICENSE + r" (?:{n})" + _VERSION, 0.7),
)
#: Families whose name says a license without the word; the other names are ordinary words too.
PLAIN_NAMES = frozenset(
    "mit apache gpl gplv1 gplv2 gplv3 lgpl lgplv2 lgplv3 agpl agplv3 bsd mpl epl cddl cc0 eupl cecill wtfpl unlicense ofl sspl isc".split()
)
#: Forms of those families, and of identifiers that stand alone or in an expression with OR and AND.
PLAIN_FORMS = (
    (
        r"(?:(?:licensed|released|distributed|available|published|provided|covered|is|are) under(?: the)?"
        r"|under the terms (?:and conditions )?of(?: the)?) (?:{n})" + _VERSION,
        0.85,
    ),
    (r"(?:\d|only|later|clause|mit|isc|zlib|x11|unlicense) (?:or|and) {t}", 0.85),
)
#: Identifiers with a version or clause: label, keyword, expression, confidence.
IDENTIFIERS = (
    ("apache", "apache", r"apache 2 0", 0.8),
    ("bsd", "bsd", r"bsd [0234] clause", 0.8),
    ("gpl", "gpl", r"gpl [123] 0(?: only| or later)?", 0.8),
    ("lgpl", "lgpl", r"lgpl [23] [01](?: only| or later)?", 0.8),
    ("agpl", "agpl", r"agpl [13] 0(?: only| or later)?", 0.8),
    ("mpl", "mpl", r"mpl [12] [01]", 0.8),
    ("epl", "epl", r"epl [12] 0", 0.8),
    ("cddl", "cddl", r"cddl 1 [01]", 0.8),
    ("eupl", "eupl", r"eupl 1 [012]", 0.8),
    ("cc0", "cc0", r"cc0 1 0", 0.8),
    ("cc-by", "cc", r"cc by [1234] 0", 0.8),
    ("cc-by-sa", "sa", r"cc by sa [1234] 0", 0.8),
    ("cc-by-nc", "nc", r"cc by nc [1234] 0", 0.8),
    ("cc-by-nd", "nd", r"cc by nd [1234] 0", 0.8),
)
#: Texts of notices that name no license: label, keyword, expression, confidence.
NOTICES = (
    ("mit", "permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 0.9),
    ("isc", "permission", r"provided that the above copyright notice and this permission notice appear in all copies", 0.85),
    ("boost", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy", 0.95),
    ("bsd", "redistributions", r"redistributions of source code must retain the (?:above )?copyright notice", 0.9),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the (?:above )?copyright notice", 0.9),
    ("bsd", "endorse", r"may be used to endorse or promote products derived from this software", 0.85),
    ("apache", "compliance", r"you may not use this file except in compliance with the licen[sc]e", 0.8),
    ("apache", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e", 0.8),
    ("gpl", "option", r"either version [123] of the licen[sc]e or at your option any later version", 0.8),
    ("gpl", "hope", r"this program is distributed in the hope that it will be useful", 0.8),
    ("lgpl", "hope", r"this library is distributed in the hope that it will be useful", 0.8),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 0.9),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 0.9),
    ("unlicense", "unencumbered", r"this is free and unencumbered software", 0.95),
    ("cc0", "waived", r"to the extent possible under law (?:\S+ ){1,8}waived all copyright", 0.9),
    ("python", "beopen", r"beopen python open source licen[sc]e agreement", 0.9),
    ("disclaimer", "merchantability", r"warrant(?:y|ies) of merchantability(?: and| or)?(?: fitness for a particular purpose)?", 0.3),
    ("disclaimer", "liable", r"in no event (?:shall|will) (?:\S+ ){1,8}be (?:held )?liable", 0.3),
    ("license-file", "see", r"see (?:the )?(?:accompanying )?(?:file )?(?:licen[sc]e|copying)(?: lesser)?(?: md| txt| rst)?(?: file)?(?: for (?:more )?(?:details|information))?", 0.4),
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 0.95),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification", 0.95),
    ("bsd", "neither", r"neither the name of (?:the )?\S+(?: \S+){0,6} nor the names of its contributors", 0.9),
    ("gpl", "free", r"this program is free software you can redistribute it and or modify", 0.9),
    ("lgpl", "free", r"this library is free software you can redistribute it and or modify", 0.9),
    ("public-domain", "domain", r"(?:released |placed |dedicated )?(?:in|into|to) the public domain", 0.8),
    ("proprietary", "reserved", r"all rights reserved", 0.5),
    ("proprietary", "confidential", r"proprietary and confidential", 0.8),
    ("warranty", "warranty", r"without (?:any )?warranty(?: of any kind)?", 0.3),
    ("copyright", "copyright", r"copyright (?:c )?\d{4}", 0.3),
)


#: Finds of a block in running combinations.
BLOCK = 64
#: Every form of a family holds the first, every notice one of the others, within a word.
GATES = (
    "licen", "permission", "redistribut", "contributors", "domain", "reserved", "confidential", "warrant", "copyright", "endorse",
    "hope that it will", "altered", "misrepresented", "unencumbered", "liable", "copying",
)
#: Names that are rules of their own, as whole words of the text before it is reduced.
SHORT_GATE = r"(?<![a-z0-9])(?:mit|isc|zlib|x11|apache|[al]?gpl(?:v[123])?|bsd|[me]pl|cddl|cc0|cc|eupl|cecill|wtfpl|ofl|sspl)(?![a-z0-9])"


def rules():
    """(priority, label, keyword, expression, confidence), in order: base phrases, forms, notices."""
    found = [(label, phrase.split(" ")[0], phrase, 0.85) for phrase, label in BASE]
    for form, confidence in FORMS:
        for label, keyword, name, tag in FAMILIES:
            if (filling := tag if "{t}" in form else name) is not None:
                found.append((label, keyword, form.replace("{n}", filling).replace("{t}", filling), confidence))
    for form, confidence in PLAIN_FORMS:
        for label, keyword, name, tag in FAMILIES:
            if keyword in PLAIN_NAMES and (filling := tag if "{t}" in form else name) is not None:
                found.append((label, keyword, form.replace("{n}", filling).replace("{t}", f"(?:{filling})"), confidence))
    found += [*IDENTIFIERS, *NOTICES]
    return [
        (k, label, keyword, rf"(?<= )(?:{expression})(?= )", confidence)
        for k, (label, keyword, expression, confidence) in enumerate(found)
    ]


def _rule_array(chosen):
    return F.array(
        *[
            F.struct(
                F.lit(k).alias("priority"),
                F.lit(label).alias("label"),
                F.lit(f" {keyword} ").alias("keyword"),
                F.lit(expression).alias("expression"),
                F.lit(confidence).alias("confidence"),
            )
            for k, label, keyword, expression, confidence in chosen
        ]
    )


def _blanks(c):
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _let(value, use):
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(values, start, combine):
    """Running combination up to and with each value.

    Values are combined in blocks first, so that a value looks at the blocks before it and at its own block
    only: n values take some n * BLOCK / 2 + (n / BLOCK)**2 / 2 steps.
    """

    def within(v):
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")),
            lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, BLOCK), start, combine),
        )

        def with_blocks(done):
            heads = F.transform(done, lambda _, b: F.aggregate(F.slice(done, 1, b), start, combine))

            def with_heads(head):
                block = lambda i: F.floor(i / BLOCK).cast("int")
                return F.transform(
                    v, lambda _, i: F.aggregate(F.slice(v, block(i) * BLOCK + 1, i % BLOCK + 1), F.get(head, block(i)), combine)
                )

            return _let(heads, with_heads)

        return F.when(F.size(v) > 0, _let(blocks, with_blocks)).otherwise(v)

    return _let(values, within)


def _places(norm, rule):
    """Word ranges of all matches of a rule, as (first, -stop, priority, label, confidence)."""
    found = F.regexp_extract_all(norm, rule["expression"], F.lit(0))
    between = F.split(norm, rule["expression"])
    # words begun before match i: blanks before it, less the leading one
    cut = F.struct(
        F.transform(between, _blanks).alias("before"), F.transform(found, _blanks).alias("inside")
    )

    def places(c):
        # blanks up to each match: those of the text before it and of the match before it
        steps = F.transform(c["inside"], lambda _, i: F.get(c["before"], i) + F.when(i > 0, F.get(c["inside"], i - 1)).otherwise(0))
        pairs = F.arrays_zip(c["inside"].alias("blanks"), _running(steps, F.lit(0), lambda a, v: a + v).alias("upto"))

        def place(p):
            first = p["upto"] - 1
            return F.struct(
                first.cast("long").alias("first"),
                (-(first + p["blanks"] + 1)).cast("long").alias("minus_stop"),
                rule["priority"].alias("priority"),
                rule["label"].alias("label"),
                rule["confidence"].alias("confidence"),
            )

        return F.transform(pairs, place)

    return _let(cut, places)


def _finds(norm, chosen):
    """Matches of all rules whose keyword is there, in the order of place, width, priority."""
    tried = F.filter(_rule_array(chosen), lambda r: F.contains(norm, r["keyword"]))
    return F.array_sort(F.flatten(F.transform(tried, lambda r: _places(norm, r))))


def _kept(finds):
    """Finds that no earlier one in the order covers: those whose end lies beyond all ends before."""

    def kept(f):
        ends = F.transform(f, lambda x: -x["minus_stop"])
        farthest = _running(ends, F.lit(0).cast("long"), lambda a, v: F.greatest(a, v))
        return _let(farthest, lambda m: F.filter(f, lambda x, i: (i == 0) | (-x["minus_stop"] > F.get(m, i - 1))))

    return _let(finds, kept)


def scan(documents):
    """All license finds of each document.

    Returns doc_id, n_words, base (places of the base phrases, unsuppressed) and finds (those kept), each
    an array of (first, minus_stop, priority, label, confidence) with word numbers from 0. Null texts count
    as empty. Only doc_id and text are read; every row gives one row, repeated ones too. Texts of any length
    are scanned whole, in time that grows little faster than their finds.
    """
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = rules()
    docs = documents.select("doc_id", lower.alias("_lower"))
    gate = reduce(or_, [F.contains("_lower", F.lit(word)) for word in GATES]) | F.rlike("_lower", F.lit(SHORT_GATE))
    words = F.regexp_extract_all("_lower", F.lit(LICENSE_WORD), F.lit(0))
    docs = docs.select(
        "doc_id",
        F.regexp_count("_lower", F.lit(LICENSE_WORD)).cast("long").alias("n_words"),
        # a blank on either side of every word; a match leaves its outer blanks to its neighbours
        F.when(gate, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))).alias("_norm"),
    )
    none = F.filter(_finds(F.lit(" "), chosen[:1]), lambda x: F.lit(False))
    docs = docs.select(
        "doc_id",
        "n_words",
        F.when(F.col("_norm").isNotNull(), _finds(F.col("_norm"), chosen)).otherwise(none).alias("_all"),
    )
    return docs.select(
        "doc_id",
        "n_words",
        F.filter("_all", lambda x: x["priority"] < len(BASE)).alias("base"),
        _kept(F.col("_all")).alias("finds"),
    )


def license_summary(documents):
    """One row per document of ``scan``: counts, first and last base place, labels and a score.

    base_labels and labels are distinct, sorted and joined by commas, empty if none; labels also has the
    labels of the finds kept. score is the largest confidence of a base place or find, 0 without any.
    """
    found = scan(documents)
    labels = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    both = F.transform(F.concat("base", "finds"), lambda x: x["confidence"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["first"])).alias("last_word"),
        joined(labels(F.col("base"))).alias("base_labels"),
        joined(F.concat(labels(F.col("base")), labels(F.col("finds")))).alias("labels"),
        F.coalesce(F.array_max(both), F.lit(0.0)).alias("score"),
        F.size("finds").cast("long").alias("n_finds"),
    )
