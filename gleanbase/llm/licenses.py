"""Licence scans by sentence rules: known sentences, then rules on their order.

A text is normalised and cut into sentences; those known by heart become identifiers, also
where they differ from a known one only in a slot (what is licensed and how, how a licence and
its version are written, whose name may not be used), and the sequence of identifiers is matched against ordered rules. All of it is column
expressions within the row, without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# Sentences of public licences and of usual notices, in normalised form (lower
# case, other characters than a-z and 0-9 as one space).
SENTENCES = {
    "apache-notice-1": "licensed under the apache license version 2 0 the license",
    "apache-notice-2": "you may not use this file except in compliance with the license",
    "apache-notice-3": "you may obtain a copy of the license at",
    "apache-ref": "licensed under the apache license version 2 0",
    "apache-ref-2": "this project is licensed under the apache license version 2 0",
    "mit-title": "mit license",
    "mit-title-2": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files the software to deal in the software without restriction including "
                 "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                 "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                 "the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or "
                  "substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not "
                    "limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-ref": "released under the mit license",
    "mit-ref-2": "licensed under the mit license",
    "mit-ref-3": "this project is licensed under the mit license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted "
                 "provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and "
                  "the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions "
                  "and the following disclaimer in the documentation and or other materials provided with the "
                  "distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                 "promote products derived from this software without specific prior written permission",
    "bsd2-ref": "licensed under the bsd 2 clause license",
    "bsd3-ref": "licensed under the bsd 3 clause license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                 "hereby granted provided that the above copyright notice and this permission notice appear in all "
                 "copies",
    "gpl-share": "this program is free software",
    "gpl-terms-3": "you can redistribute it and or modify it under the terms of the gnu general public license as "
                   "published by the free software foundation either version 3 of the license or at your option any "
                   "later version",
    "gpl-terms-2": "you can redistribute it and or modify it under the terms of the gnu general public license as "
                   "published by the free software foundation either version 2 of the license or at your option any "
                   "later version",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl3-ref-2": "licensed under the gnu general public license version 3",
    "gpl2-ref": "licensed under the gnu general public license version 2",
    "lgpl3-ref": "licensed under the gnu lesser general public license version 3",
    "agpl3-ref": "licensed under the gnu affero general public license version 3",
    "mpl-notice-1": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-ref": "licensed under the mozilla public license version 2 0",
    "cc0-ref": "licensed under cc0 1 0",
    "cc-by-ref": "licensed under cc by 4 0",
    "cc-by-sa-ref": "licensed under cc by sa 4 0",
    "cc-by-nc-ref": "licensed under cc by nc 4 0",
    "cc-by-nd-ref": "licensed under cc by nd 4 0",
    "cc-by-nc-sa-ref": "licensed under cc by nc sa 4 0",
    "cc-by-nc-nd-ref": "licensed under cc by nc nd 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "reserved": "all rights reserved",
}

# More sentences of notices, and names of licences as tags have them.
SENTENCES |= {
    "gpl-share-lib": "this library is free software",
    "gpl-only-2": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as "
                  "published by the free software foundation",
    "gpl-only-3": "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as "
                  "published by the free software foundation",
    "lgpl-terms-21": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
                     "published by the free software foundation either version 2 1 of the license or at your option any "
                     "later version",
    "lgpl-terms-3": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
                    "published by the free software foundation either version 3 of the license or at your option any "
                    "later version",
    "gpl3-later-ref": "licensed under the gnu general public license version 3 or later",
    "gpl2-later-ref": "licensed under the gnu general public license version 2 or later",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
TAGS = {
    "mit": "MIT", "apache 2 0": "Apache-2.0", "bsd 2 clause": "BSD-2-Clause", "bsd 3 clause": "BSD-3-Clause", "isc": "ISC",
    "mpl 2 0": "MPL-2.0", "gpl 2 0 only": "GPL-2.0-only", "gpl 2 0": "GPL-2.0-only", "gpl 2 0 or later": "GPL-2.0-or-later",
    "gpl 3 0 only": "GPL-3.0-only", "gpl 3 0": "GPL-3.0-only", "gpl 3 0 or later": "GPL-3.0-or-later",
    "lgpl 2 1 only": "LGPL-2.1-only", "lgpl 2 1 or later": "LGPL-2.1-or-later", "lgpl 3 0 only": "LGPL-3.0-only",
    "lgpl 3 0 or later": "LGPL-3.0-or-later", "agpl 3 0 only": "AGPL-3.0-only", "agpl 3 0 or later": "AGPL-3.0-or-later",
    "unlicense": "Unlicense", "cc0 1 0": "CC0-1.0",
}
CC_KINDS, CC_VERSIONS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"), ("2 0", "2 5", "3 0")
_CC_OLD = {f"cc {kind} {version}": f"CC-{kind.upper().replace(' ', '-')}-{version.replace(' ', '.')}"
           for kind in CC_KINDS for version in CC_VERSIONS}
TAGS |= _CC_OLD | {f"cc {kind} 4 0": f"CC-{kind.upper().replace(' ', '-')}-4.0" for kind in CC_KINDS}
SENTENCES |= {f"tag-{name.replace(' ', '-')}": f"spdx license identifier {name}" for name in TAGS}
SENTENCES |= {f"{name.replace(' ', '-')}-ref": f"licensed under {name}" for name in _CC_OLD}

# Slots, applied in order to a sentence that is not known as it is: (pattern, replacement). What
# they make of it is known if it is one of the sentences. Every pattern holds a word of SLOT_WORDS.
_LEAD = (r"^(?:(?:this|the|our|all) (?:[a-z]+ ){1,3}|it )?(?:(?:is|are) )?(?:released|licensed|distributed|available|published|provided|"
         r"made available) under (?:the )?(?:terms of (?:the )?)?")
_VERSION = r"(?:license )?(?:version |v )?v?"
SLOT_WORDS = ("under", "endorse")
SLOTS = (
    (_LEAD + r"(?:mit|mit licen[cs]e|expat licen[cs]e)$", "licensed under the mit license"),
    (_LEAD + r"apache (?:software )?" + _VERSION + r"2(?: 0)?(?: license)?$", "licensed under the apache license version 2 0"),
    (_LEAD + r"(?:(?:new|modified) bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?$", "licensed under the bsd 3 clause license"),
    (_LEAD + r"(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?$", "licensed under the bsd 2 clause license"),
    (_LEAD + r"(?:gnu general public|gnu gpl|gpl) ?" + _VERSION + r"([23])(?: 0)?(?: only)?(?: license)?$",
     r"licensed under the gnu general public license version \1"),
    (_LEAD + r"(?:gnu general public|gnu gpl|gpl) ?" + _VERSION + r"([23])(?: 0)? or (?:at your option )?(?:any )?later(?: version)?$",
     r"licensed under the gnu general public license version \1 or later"),
    (_LEAD + r"(?:gnu lesser general public|gnu lgpl|lgpl) ?" + _VERSION + r"3(?: 0)?(?: only)?$",
     "licensed under the gnu lesser general public license version 3"),
    (_LEAD + r"(?:gnu affero general public|gnu agpl|agpl) ?" + _VERSION + r"3(?: 0)?(?: only)?$",
     "licensed under the gnu affero general public license version 3"),
    (_LEAD + r"(?:mozilla public|mpl) ?" + _VERSION + r"2(?: 0)?$", "licensed under the mozilla public license version 2 0"),
    (_LEAD + r"(?:a |an )?(?:creative commons|cc) (?:attribution|by)(.*) ([1-4] [05])(?: international| unported| generic)?(?: license)?$",
     r"licensed under cc by\1 \2"),
    (r"^(licensed under cc by.*) (?:noncommercial|non commercial)\b", r"\1 nc"),
    (r"^(licensed under cc by.*) (?:sharealike|share alike)\b", r"\1 sa"),
    (r"^(licensed under cc by.*) (?:noderivatives|noderivs|no derivatives)\b", r"\1 nd"),
    (_LEAD + r"(?:the )?cc0(?: 1 0)?(?: universal)?$", "licensed under cc0 1 0"),
    (r"^neither the names? of .+ nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from "
     r"this software without specific prior written permission$", SENTENCES["bsd-names"]),
)

# Ordered rules: (licence, sentences that must follow each other among those recognised).
# The first rule that matches names the text's main licence.
RULES = (
    ("Apache-2.0", ("apache-notice-1", "apache-notice-2", "apache-notice-3")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-share", "gpl-terms-3")),
    ("GPL-2.0-or-later", ("gpl-share", "gpl-terms-2")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-notice-1", "apache-notice-2")),
    ("MIT", ("mit-grant",)),
    ("Apache-2.0", ("apache-ref",)),
    ("Apache-2.0", ("apache-ref-2",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref-2",)),
    ("MIT", ("mit-ref-3",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-title-2",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-3.0-only", ("gpl3-ref-2",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("LGPL-3.0-only", ("lgpl3-ref",)),
    ("AGPL-3.0-only", ("agpl3-ref",)),
    ("MPL-2.0", ("mpl-notice-1",)),
    ("MPL-2.0", ("mpl-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-ref",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-ref",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-ref",)),
    ("GPL-2.0-only", ("gpl-share", "gpl-only-2")),
    ("GPL-3.0-only", ("gpl-share", "gpl-only-3")),
    ("LGPL-2.1-or-later", ("gpl-share-lib", "lgpl-terms-21")),
    ("LGPL-3.0-or-later", ("gpl-share-lib", "lgpl-terms-3")),
    ("GPL-3.0-or-later", ("gpl3-later-ref",)),
    ("GPL-2.0-or-later", ("gpl2-later-ref",)),
    ("Unlicense", ("unlicense",)),
    *((licence, (f"{name.replace(' ', '-')}-ref",)) for name, licence in _CC_OLD.items()),
    *((licence, (f"tag-{name.replace(' ', '-')}",)) for name, licence in TAGS.items()),
    ("reserved", ("reserved",)),
)

# Applied in order to the lower-cased text: (pattern, replacement).
STEPS = (
    (r"spdx-license-identifier:", "spdx license identifier"),
    (r"foundation;[^a-z0-9]+either", "foundation either"),
    (r"[^a-z0-9.;:!?\n]+", " "),
    (r"[.;:!?]+[ \n]+|[.;:!?]+\z|\n[ \n]*\n", "\n\n"),  # ends of sentences, empty lines
    (r"[.;:!?]+", " "),
    (r" +", " "),
)


def sentences(text: Column) -> tuple[Column, Column]:
    """Normalised sentences; first with a line break inside a sentence as a space, for
    wrapped text, then with each line by itself, for notices below unfinished lines."""
    text = F.lower(text)
    for pattern, by in STEPS:
        text = F.regexp_replace(text, pattern, by)
    wrapped = F.regexp_replace(F.regexp_replace(text, r" ?\n\n[ \n]*", "."), r"[ \n]+", " ")
    return F.split(wrapped, r"\."), F.split(text, r"\n")


def slotted(sentence: Column) -> Column:
    """The sentence with its slots filled in as in a known one."""
    for pattern, by in SLOTS:
        sentence = F.regexp_replace(sentence, pattern, re.sub(r"\\(\d)", r"$\1", by))
    return sentence


def known(found: Column) -> Column:
    """Identifiers of the known sentences among ``found``, in order."""
    table = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in reversed(pair)))

    def may(s: Column) -> Column:  # a slot is tried on few sentences only
        out = s.isin(*SENTENCES.values())
        for word in SLOT_WORDS:
            out = out | F.contains(s, F.lit(word))
        return out

    few = F.filter(F.transform(found, lambda s: F.trim(s)), may)
    return F.array_compact(F.transform(few, lambda s: F.coalesce(table[s], table[slotted(s)])))


def scan(docs: DataFrame, text: str = "text",
         into: tuple[str, str, str] = ("sentence_ids", "licenses", "license")) -> DataFrame:
    """``docs`` with the known sentences of each whole text, all licences whose rules match
    (in rule order, each once) and the first of them.

    A rule matches where its sentences follow each other among those recognised, in the
    wrapped or in the line reading. Sentence identifiers are those of the longer reading,
    the wrapped one if equal. Null and empty texts have no sentences, no licences (empty
    arrays) and a null licence. Columns named as ``into`` are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in into and c != text])
    wrapped, lines = sentences(F.coalesce(F.col(text), F.lit("")))
    pair, sought = fresh(docs, "_both", "_read")
    both = docs.withColumn(pair, F.array(known(wrapped), known(lines)))
    joined = [F.concat(F.lit(","), F.concat_ws(",", F.col(pair)[k]), F.lit(",")) for k in (0, 1)]
    read = both.withColumn(sought, F.concat(joined[0], F.lit("|"), joined[1]))
    hits = F.array_distinct(F.filter(F.array(*(
        F.when(F.contains(F.col(sought), F.lit(f",{','.join(ids)},")), F.lit(name)) for name, ids in RULES)),
        lambda name: name.isNotNull()))
    empty = F.lit(None).cast("array<string>")
    some = F.size(F.col(pair)[0]) + F.size(F.col(pair)[1]) > 0
    longer = F.when(F.size(F.col(pair)[1]) > F.size(F.col(pair)[0]), F.col(pair)[1]).otherwise(F.col(pair)[0])
    made = read.withColumn(into[0], longer).withColumn(
        into[1], F.when(some, hits).otherwise(F.coalesce(empty, F.array().cast("array<string>"))))
    return made.withColumn(into[2], F.get(F.col(into[1]), F.lit(0))).drop(pair, sought)
