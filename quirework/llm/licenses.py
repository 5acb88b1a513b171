"""Licence scans by sentence rules; DataFrame functions only.

Known sentences that are wrapped over several lines, with comment marks or not, are put on one line
first; blank lines part sentences. A text is then cut into sentences at line ends and at sentence ends
followed by white space. A sentence is
normalised: lower case, whatever is not a letter, digit or dot becomes a space, outer dots go. Known
sentences map to identifiers, and a document becomes the sequence of its sentences' identifiers. A
rule is an ordered list of identifiers; it is met if they occur in that order, other sentences in
between allowed. A rule whose identifiers are part of a longer rule that is met is not reported for
the same licence, and reserved rights alone are reported only where no licence is met. Files' licence
tags (``SPDX-License-Identifier: MIT``) are sentences too.

Null and empty texts have no sentences and meet no rule. Repeated rows are judged alike. Null ids are
kept. The knowledge of sentences and rules is fixed and small, and sits in the plan as literals.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence sentences by identifier, as they are normalised from the licences' notices. Fixed values.
SENTENCES = {
    "gpl3-line": "this work is licensed under the gnu general public license version 3.",
    "gpl2-line": "this work is licensed under the gnu general public license version 2.",
    "apache2-line": "licensed under the apache license version 2.0.",
    "mit-line": "released under the mit license.",
    "ccbync4-line": "licensed under cc by-nc 4.0.",
    "ccby4-line": "licensed under cc by 4.0.",
    "ccbysa4-line": "licensed under cc by-sa 4.0.",
    "cc0-line": "released under cc0 1.0.",
    "bsd3-line": "released under the bsd 3-clause license.",
    "mpl2-line": "licensed under the mozilla public license version 2.0.",
    "reserved": "all rights reserved.",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement.",
    "apache2-comply": "you may not use this file except in compliance with the license.",
    "apache2-copy": "you may obtain a copy of the license at",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version.",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose.",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mit-title": "mit license", "mit-title-the": "the mit license", "mit-title-mit": "the mit license mit", "mit-licensed": "licensed under the mit license.",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version.",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation.",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version.",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version.",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version.",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v",
    "unlicense-free": "this is free and unencumbered software released into the public domain.",
    "boost-line": "distributed under the boost software license version 1.0.", "boost-title": "boost software license version 1.0",
    "epl1-available": "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution and is available at",
    "epl2-available": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at",
    "ccby4-long": "this work is licensed under a creative commons attribution 4.0 international license.", "ccby4-long-the": "this work is licensed under the creative commons attribution 4.0 international license.",
    "ccbysa4-long": "this work is licensed under a creative commons attribution-sharealike 4.0 international license.",
    "ccbync4-long": "this work is licensed under a creative commons attribution-noncommercial 4.0 international license.",
}
#: Licences by the tags that name them in files. Fixed values.
TAGS = ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-1.0", "EPL-2.0", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
SENTENCES |= {f"tag-{t.lower()}": f"spdx-license-identifier {t.lower()}" for t in TAGS}
#: Ordered rules: licence, and the identifiers that must follow one another. Fixed values.
RULES = (
    ("GPL-3.0", ("gpl3-line",)), ("GPL-2.0", ("gpl2-line",)), ("Apache-2.0", ("apache2-line",)), ("MIT", ("mit-line",)),
    ("CC-BY-NC-4.0", ("ccbync4-line",)), ("CC-BY-4.0", ("ccby4-line",)), ("CC-BY-SA-4.0", ("ccbysa4-line",)), ("CC0-1.0", ("cc0-line",)),
    ("BSD-3-Clause", ("bsd3-line",)), ("MPL-2.0", ("mpl2-line",)), ("proprietary", ("reserved",)), ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("Apache-2.0", ("apache2-line", "apache2-comply", "apache2-copy")), ("GPL-3.0", ("gpl-free", "gpl-hope")), ("BSD", ("bsd-redistribution",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-endorse")), ("MIT", ("mit-title",)), ("MIT", ("mit-title-the",)), ("MIT", ("mit-title-mit",)), ("MIT", ("mit-licensed",)),
    ("GPL-2.0-or-later", ("gpl2-free",)), ("GPL-2.0-only", ("gpl2-only",)), ("AGPL-3.0-or-later", ("agpl3-free",)), ("LGPL-2.1-or-later", ("lgpl21-free",)), ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("ISC", ("isc-grant",)), ("MPL-2.0", ("mpl2-form",)), ("Unlicense", ("unlicense-free",)), ("BSL-1.0", ("boost-line",)), ("BSL-1.0", ("boost-title",)), ("EPL-1.0", ("epl1-available",)), ("EPL-2.0", ("epl2-available",)),
    ("CC-BY-4.0", ("ccby4-long",)), ("CC-BY-4.0", ("ccby4-long-the",)), ("CC-BY-SA-4.0", ("ccbysa4-long",)), ("CC-BY-NC-4.0", ("ccbync4-long",)),
    *((tag, (f"tag-{tag.lower()}",)) for tag in TAGS),
)
#: Licences that say something only where no other is met: "all rights reserved" stands in many free notices.
ALONE = ("proprietary",)
#: Notices that hold several known sentences in one, as they are normalised. Fixed values.
JOINED = {"licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license.": ("apache2-line", "apache2-comply")}
_KEPT = r"[^a-z0-9.-]+"
#: What may stand between the words of a wrapped sentence: no letter, digit or dot, and no blank line.
_BETWEEN = r"(?:(?!\n[^A-Za-z0-9\n]*\n)[^A-Za-z0-9.])++"
_ENDS = r"\r?\n|(?<=[.!?])[ \t]+"


def normalised(sentence: str) -> str:
    """The Python restatement of ``normalise``, for the table above."""
    s = re.sub(_KEPT, " ", sentence.lower())
    return re.sub(r"\.+(?= |$)|^[ .-]+|[ .-]+$", "", re.sub(r"(?<=[a-z0-9])\.+$", "", s)).strip()


def normalise(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), _KEPT, " "), r"\.+(?= |$)|^[ .-]+|[ .-]+$", ""))


def unwrapped(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """A text with its known sentences on a line each, whatever lines they were wrapped over."""
    joined = {s: ids for s, ids in JOINED.items() if set(ids) <= sentences.keys()}
    wordings = joined | {s: (key,) for key, s in sentences.items()}
    hints = sorted({max(normalised(s).split(), key=len) for s in wordings})
    out = text
    for s, ids in wordings.items():
        ends = r"(?=[^A-Za-z0-9\n]*(?:\n|\z|[.!?][ \t]))"
        pattern = r"(?i)(\A|\n|[.!?][ \t]+)[^A-Za-z0-9\n]*" + _BETWEEN.join(map(re.escape, normalised(s).split())) + ends
        out = F.regexp_replace(out, pattern, "$1\n" + "\n".join(normalised(sentences[i]) for i in ids) + "\n")
    lower = F.lower(text)
    hinted = F.lit(False)
    for h in hints:
        hinted |= F.contains(lower, F.lit(h))
    return F.when(hinted, out).otherwise(text)


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for key, s in sentences.items() for x in (normalised(s), key)])
    least = min(len(normalised(s)) for s in sentences.values())
    cut_up = F.split(unwrapped(F.coalesce(text, F.lit("")), sentences), _ENDS)
    able = F.filter(cut_up, lambda s: F.length(s) >= least)
    met = F.filter(F.transform(able, normalise), lambda s: s.isin([normalised(x) for x in sentences.values()]))
    return F.transform(met, lambda s: F.element_at(known, s))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> DataFrame:
    """``(id_col, licence, rule, sentences)`` for each rule that a row of ``docs`` meets."""
    rows = docs.select(F.col(id_col).alias("id"), F.concat(F.lit(" "), F.array_join(identifiers(F.col(text_col), sentences), "  "), F.lit(" ")).alias("found")).where("found <> '  '")
    met = []
    for name, ids in rules:
        pattern = ".*".join(f" {re.escape(i)} " for i in ids)
        longer = [".*".join(f" {re.escape(i)} " for i in other) for n, other in rules if n == name and len(other) > len(ids) and set(ids) <= set(other)]
        fits = F.col("found").rlike(pattern)
        for p in longer:
            fits &= ~F.col("found").rlike(p)
        met.append(F.when(fits, F.struct(F.lit(name).alias("licence"), F.lit(" ".join(ids)).alias("rule"))))
    found = F.filter(F.array(*met), lambda m: m.isNotNull())
    others = F.filter(found, lambda m: ~m["licence"].isin(*ALONE))
    found = F.when(F.size(others) > 0, others).otherwise(found)
    count = F.size(F.split(F.trim(F.col("found")), " +"))
    return rows.select("id", count.alias("sentences"), F.inline(found)).select(F.col("id").alias(id_col), "licence", "rule", "sentences")
