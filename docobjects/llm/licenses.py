"""License scans by sentence rules: sentences become known identifiers, and their sequence is matched to rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences as they stand in public licences and notices, in normalised form, by identifier.
# Normalised: lower case, runs of other characters than letters and digits as one space, years and versions kept.
SENTENCES = {
    "AgplFree": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "AgplRef": ["licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3 0 only", "spdx license identifier agpl 3 0 or later"],
    "AgplWarranty": ["see the gnu affero general public license for more details"],
    "AllRights": ["all rights reserved"],
    "Apache2Ref": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license",
        "spdx license identifier apache 2 0",
    ],
    "ApacheAsIs": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "ApacheLimits": ["see the license for the specific language governing permissions and limitations under the license"],
    "ApacheObtain": [
        "you may obtain a copy of the license at",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "you may obtain a copy of the license at https www apache org licenses license 2 0",
    ],
    "ApacheUse": ["you may not use this file except in compliance with the license"],
    "BoostGrant": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    ],
    "BoostRef": ["distributed under the boost software license version 1 0", "spdx license identifier bsl 1 0"],
    "BsdAsIs": [
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ],
    "BsdCond": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BsdCondBin": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ],
    "BsdLiability": [
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
    ],
    "BsdNames": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BsdPre": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    ],
    "Bsd2Ref": ["released under the bsd 2 clause license", "licensed under the bsd 2 clause license", "spdx license identifier bsd 2 clause"],
    "BsdRef": ["released under the bsd license", "released under the bsd 3 clause license", "licensed under the bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "Cc0Ref": ["licensed under cc0 1 0", "this work is dedicated to the public domain under cc0 1 0", "spdx license identifier cc0 1 0"],
    "CcByNc4Ref": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "spdx license identifier cc by nc 4 0"],
    "CcBySa4Ref": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "spdx license identifier cc by sa 4 0"],
    "CcBy4Ref": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "spdx license identifier cc by 4 0"],
    "Gpl2Ref": ["this work is licensed under the gnu general public license version 2", "spdx license identifier gpl 2 0 only"],
    "Gpl2Terms": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ],
    "Gpl3LaterRef": ["spdx license identifier gpl 3 0 or later"],
    "Gpl3Ref": ["this work is licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0 only"],
    "Gpl3Terms": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "GplCopy": [
        "you should have received a copy of the gnu general public license along with this program",
        "if not see http www gnu org licenses",
        "if not see https www gnu org licenses",
    ],
    "GplDetails": ["see the gnu general public license for more details"],
    "GplFree": ["this program is free software"],
    "GplLater": ["either version 3 of the license or at your option any later version"],
    "GplWarranty": [
        "this program is distributed in the hope that it will be useful but without any warranty",
        "without even the implied warranty of merchantability or fitness for a particular purpose",
    ],
    "IscGrant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "IscRef": ["released under the isc license", "licensed under the isc license", "spdx license identifier isc"],
    "LgplRef": ["licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3 0 only", "spdx license identifier lgpl 3 0 or later"],
    "MitAsIs": [
        "the software is provided as is without warranty of any kind",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ],
    "MitLiability": [
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "MitNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "MitPermission": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ],
    "MitRef": ["released under the mit license", "licensed under the mit license", "spdx license identifier mit"],
    "Mpl2Copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "Mpl2Ref": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "licensed under the mozilla public license version 2 0",
        "spdx license identifier mpl 2 0",
    ],
    "PublicDomain": ["this work is in the public domain", "released into the public domain"],
    "UnlicenseFree": ["this is free and unencumbered software released into the public domain"],
    "UnlicenseUse": [
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ],
    "ZlibAsIs": ["this software is provided as is without any express or implied warranty"],
    "ZlibGrant": [
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ],
}

# Ordered rules; an earlier rule uses its identifiers up. A rule is a sequence of sentence identifiers.
RULES = [
    ("Apache-2.0", ["Apache2Ref", "ApacheUse", "ApacheObtain", "ApacheAsIs", "ApacheLimits"]),
    ("Apache-2.0", ["Apache2Ref", "ApacheUse", "ApacheObtain"]),
    ("Apache-2.0", ["Apache2Ref", "ApacheObtain"]),
    ("Apache-2.0", ["Apache2Ref"]),
    ("AGPL-3.0-or-later", ["AgplFree", "GplWarranty", "GplWarranty", "AgplWarranty"]),
    ("AGPL-3.0-or-later", ["AgplFree"]),
    ("AGPL-3.0", ["AgplRef"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("BSL-1.0", ["BoostRef"]),
    ("BSD-3-Clause", ["BsdPre", "BsdCond", "BsdCondBin", "BsdNames", "BsdAsIs"]),
    ("BSD-3-Clause", ["BsdPre", "BsdCond", "BsdCondBin", "BsdNames"]),
    ("BSD-2-Clause", ["BsdPre", "BsdCond", "BsdCondBin", "BsdAsIs"]),
    ("BSD-2-Clause", ["BsdPre", "BsdCond", "BsdCondBin"]),
    ("BSD-2-Clause", ["Bsd2Ref"]),
    ("BSD-3-Clause", ["BsdRef"]),
    ("CC0-1.0", ["Cc0Ref"]),
    ("CC-BY-NC-4.0", ["CcByNc4Ref"]),
    ("CC-BY-SA-4.0", ["CcBySa4Ref"]),
    ("CC-BY-4.0", ["CcBy4Ref"]),
    ("GPL-2.0-or-later", ["GplFree", "Gpl2Terms", "GplWarranty", "GplWarranty", "GplDetails"]),
    ("GPL-2.0-or-later", ["GplFree", "Gpl2Terms"]),
    ("GPL-2.0", ["Gpl2Ref"]),
    ("GPL-3.0-or-later", ["Gpl3Terms", "GplWarranty", "GplWarranty", "GplDetails", "GplCopy", "GplCopy"]),
    ("GPL-3.0-or-later", ["Gpl3Terms", "GplWarranty", "GplWarranty", "GplDetails"]),
    ("GPL-3.0-or-later", ["GplFree", "Gpl3Terms"]),
    ("GPL-3.0-or-later", ["Gpl3Terms"]),
    ("GPL-3.0-or-later", ["GplFree", "GplLater", "GplWarranty"]),
    ("GPL-3.0-or-later", ["Gpl3LaterRef"]),
    ("GPL-3.0", ["Gpl3Ref"]),
    ("ISC", ["IscGrant"]),
    ("ISC", ["IscRef"]),
    ("LGPL-3.0", ["LgplRef"]),
    ("MIT", ["MitPermission", "MitNotice", "MitAsIs", "MitLiability"]),
    ("MIT", ["MitPermission", "MitNotice", "MitAsIs"]),
    ("MIT", ["MitPermission", "MitAsIs"]),
    ("MIT", ["MitPermission"]),
    ("MIT", ["MitRef"]),
    ("MPL-2.0", ["Mpl2Ref", "Mpl2Copy"]),
    ("MPL-2.0", ["Mpl2Ref"]),
    ("Unlicense", ["UnlicenseFree", "UnlicenseUse"]),
    ("Unlicense", ["UnlicenseFree"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    ("Public-Domain", ["PublicDomain"]),
    ("Proprietary", ["AllRights"]),
]

#: Ends a sentence in a normalised text; a line end within a sentence stays a line end.
END = "\x01"

#: Steps of the normalisation, after lower case: pattern and replacement, in the syntax that Java and RE2 share.
STEPS = [
    (r"\r\n?", "\n"),
    (r":([ \t]+[^ \t\n])", r" \1"),  # a colon within a line ends nothing
    (None, END),  # . ! ? ; : before white space or the end
    (rf"[^\p{{L}}\p{{N}}\n{END}]+", " "),
    (r"\n ?\n[ \n]*", END),  # a line without letters or digits
    (r" ?\n ?", "\n"),
]


def normalised(text: Column) -> Column:
    """A text as its words with one END, line end or space between them; sentences end at END."""
    out = F.lower(text)
    for pattern, to in STEPS:
        # Runs of marks are taken whole from their first mark, so that no place is looked at twice.
        out = F.regexp_replace(out, pattern or r"(?<![.!?;:])[.!?;:]++(?=[\x20\x09-\x0D]|$)", to.replace("\\", "$"))
    return F.regexp_replace(F.concat(F.lit(END), out, F.lit(END)), rf"[ \n]?{END}[ \n{END}]*", END)


def sentence_pattern(known: list[str], gap: str) -> str:
    """Any of the known sentences, longer ones first, with `gap` between words."""
    return "|".join(gap.join(re.escape(w) for w in s.split(" ")) for s in sorted(known, key=lambda s: (-len(s), s)))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict | None = None, rules: list | None = None) -> DataFrame:
    """One row per row of df: which licences its text names, by sentence rules.

    A text is normalised: lower case, other characters than letters and digits as one space. Sentences end at . ! ? ; : before
    white space or the end (a colon only before a line end) and at lines without letters or digits. A known sentence is
    recognised where its words follow one another from the start of a sentence or line to the end of a sentence or line, however
    it is wrapped into lines; matches are taken from left to right, the longest first. Each becomes its identifier.
    The identifiers, in text order, are matched to the rules in rule order: each place
    where a rule's whole sequence stands names its licence and uses these identifiers up for later rules;
    identifiers that no rule uses are unmatched.

    doc_id, n_known (known sentences), sentence_ids (string, space-separated), licenses (string: distinct
    licences in code point order, comma-separated; '' for none), unmatched (identifiers that no rule took),
    verdict ('none', 'single', 'multiple' or 'unknown': known sentences, but no rule).
    A null or empty text gives n_known 0 and verdict 'none'; very long texts are read whole; rows with equal ids are scanned
    apart; an empty table gives an empty result; other columns are neither read nor returned, whatever their names. Everything
    is a row-local expression: no shuffle at any size.
    """
    known = {s: name for name, variants in (sentences or SENTENCES).items() for s in variants}
    rules = RULES if rules is None else rules
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    found = F.regexp_extract_all(normalised(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"(?<=[{END}\n])(?:{sentence_pattern(list(known), '[ \n]')})(?=[{END}\n])"), F.lit(0))
    ids = F.transform(found, lambda s: F.element_at(table, F.translate(s, "\n", " ")))
    sequence = F.concat(F.lit(" "), F.array_join(F.col("_ids"), " "), F.lit(" "))
    # In " A B C " the rules are rewritten to "=number" in their order, so a longer rule goes before its parts.
    marked = sequence
    for k, (_, parts) in enumerate(rules):
        marked = F.regexp_replace(marked, f"(?<= ){' '.join(parts)}(?= )", f"={k}")
    names = F.array(*[F.lit(name) for name, _ in rules])
    parts = F.filter(F.split(F.trim(F.col("_marked")), " "), lambda s: s != "")
    hits = F.filter(parts, lambda s: s.startswith("="))
    licenses = F.array_sort(F.array_distinct(F.transform(hits, lambda s: F.element_at(names, F.substring(s, 2, 9).cast("int") + 1))))
    return (
        df.select(F.col(id_col).alias("doc_id"), ids.alias("_ids"))
        .withColumn("_marked", marked)
        .withColumn("_licenses", licenses)
        .select(
            "doc_id",
            F.size("_ids").cast("long").alias("n_known"),
            F.array_join("_ids", " ").alias("sentence_ids"),
            F.array_join("_licenses", ",").alias("licenses"),
            F.size(F.filter(parts, lambda s: ~s.startswith("="))).cast("long").alias("unmatched"),
            F.when(F.size("_ids") == 0, "none").when(F.size("_licenses") == 0, "unknown").when(F.size("_licenses") == 1, "single").otherwise("multiple").alias("verdict"),
        )
    )
