"""License scans by ordered signature rules.

A rule is a pattern, a priority and the label it stands for. Rules are gated by keywords: a document is only put to the
rules of whose keyword it holds every word, wherever they stand, since a rule's words may be apart by any white space. Overlapping detections are resolved by priority and containment: one that lies within a
detection of higher priority, or within a longer one of its own priority, is suppressed.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from upland.llm.common import byte_view, slices, text_of

# fixed values: the base phrases and their labels
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# fixed values: label, keyword (words that every name holds; | between those of different names), names (patterns), short identifier
LICENSES = (
    ("mit", "mit|expat", r"mit(?: license)?|expat license", "mit"),
    ("apache-1.1", "apache", r"apache (?:software )?license,? (?:version |v\.? ?)?1\.1", r"apache-1\.1"),
    ("apache-2.0", "apache", r"apache (?:software )?license,? (?:version |v\.? ?)?2(?:\.0)?", r"apache-2\.0"),
    ("gpl-1.0", "general public", r"gnu general public license,? (?:version |v\.? ?)?1(?:\.0)?", r"gpl-1\.0(?:-only|-or-later|\+)?"),
    ("gpl-2.0", "general public", r"gnu general public license,? (?:version |v\.? ?)?2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?"),
    ("gpl-3.0", "general public", r"gnu general public license,? (?:version |v\.? ?)?3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?"),
    ("lgpl-2.0", "library general", r"gnu library general public license,? (?:version |v\.? ?)?2(?:\.0)?", r"lgpl-2\.0(?:-only|-or-later|\+)?"),
    ("lgpl-2.1", "lesser general", r"gnu lesser general public license,? (?:version |v\.? ?)?2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?"),
    ("lgpl-3.0", "lesser general", r"gnu lesser general public license,? (?:version |v\.? ?)?3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later|\+)?"),
    ("agpl-3.0", "affero", r"gnu affero general public license,? (?:version |v\.? ?)?3(?:\.0)?", r"agpl-3\.0(?:-only|-or-later|\+)?"),
    ("gfdl", "free documentation", r"gnu free documentation license", r"gfdl-1\.[123](?:-only|-or-later)?"),
    ("bsd-2-clause", "bsd", r"(?:2|two)[- ]clause bsd license|simplified bsd license|freebsd license", "bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:3|three)[- ]clause bsd license|(?:new|modified|revised) bsd license", "bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:4|four)[- ]clause bsd license|original bsd license", "bsd-4-clause"),
    ("0bsd", "bsd", r"zero[- ]clause bsd(?: license)?|bsd zero clause license", "0bsd"),
    ("isc", "isc", r"isc license", "isc"),
    ("mpl-1.1", "mozilla", r"mozilla public license,? (?:version |v\.? ?)?1\.1", r"mpl-1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla public license,? (?:version |v\.? ?)?2(?:\.0)?", r"mpl-2\.0"),
    ("epl-1.0", "eclipse", r"eclipse public license,? (?:version |v\.? ?)?1(?:\.0)?", r"epl-1\.0"),
    ("epl-2.0", "eclipse", r"eclipse public license,? (?:version |v\.? ?)?2(?:\.0)?", r"epl-2\.0"),
    ("cddl-1.0", "common development", r"common development and distribution license", r"cddl-1\.[01]"),
    ("cpl-1.0", "common public", r"common public license", r"cpl-1\.0"),
    ("ms-pl", "microsoft public", r"microsoft public license", "ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal license", "ms-rl"),
    ("artistic-1.0", "artistic", r"artistic license,? (?:version |v\.? ?)?1(?:\.0)?", r"artistic-1\.0"),
    ("artistic-2.0", "artistic", r"artistic license,? (?:version |v\.? ?)?2(?:\.0)?", r"artistic-2\.0"),
    ("zlib", "zlib", r"zlib license|zlib/libpng license", "zlib"),
    ("unlicense", "unlicense", r"unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", "wtfpl"),
    ("bsl-1.0", "boost", r"boost software license", r"bsl-1\.0"),
    ("python-2.0", "python software", r"python software foundation license", r"(?:python|psf)-2\.0"),
    ("postgresql", "postgresql", r"postgresql license", "postgresql"),
    ("openssl", "openssl", r"openssl license", "openssl"),
    ("ofl-1.1", "open font", r"sil open font license", r"ofl-1\.1"),
    ("odbl-1.0", "open database", r"open (?:data commons )?open database license|open database license", r"odbl-1\.0"),
    ("eupl-1.2", "european union public", r"european union public licen[cs]e", r"eupl-1\.[12]"),
    ("cecill-2.1", "cecill", r"cecill(?:-[bc])?(?: license)?", r"cecill-2\.[01]"),
    ("cc0-1.0", "cc0", r"cc0(?: 1\.0)?(?: universal)?", r"cc0-1\.0"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4]\.[05])?(?: international| unported)? license", r"cc-by-[1-4]\.[05]"),
    ("cc-by-sa", "creative commons", r"creative commons attribution[- ]share ?alike(?: [1-4]\.[05])?(?: international| unported)?(?: license)?", r"cc-by-sa-[1-4]\.[05]"),
    ("cc-by-nc", "creative commons", r"creative commons attribution[- ]non ?commercial(?: [1-4]\.[05])?(?: international| unported)?(?: license)?", r"cc-by-nc-[1-4]\.[05]"),
    ("cc-by-nd", "creative commons", r"creative commons attribution[- ]no ?derivatives(?: [1-4]\.[05])?(?: international| unported)?(?: license)?", r"cc-by-nd-[1-4]\.[05]"),
)
# fixed values: places of license texts
LINKS = (
    ("mit", r"opensource\.org/licenses?/mit"), ("apache-2.0", r"apache\.org/licenses/license-2\.0"), ("gpl-3.0", r"gnu\.org/licenses/gpl-3\.0"), ("gpl-2.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("lgpl-3.0", r"gnu\.org/licenses/lgpl-3\.0"), ("agpl-3.0", r"gnu\.org/licenses/agpl-3\.0"), ("mpl-2.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"), ("cc0-1.0", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc-by", r"creativecommons\.org/licenses/by/[1-4]\.[05]"), ("cc-by-sa", r"creativecommons\.org/licenses/by-sa/[1-4]\.[05]"), ("cc-by-nc", r"creativecommons\.org/licenses/by-nc/[1-4]\.[05]"), ("unlicense", r"unlicense\.org"),
)
# fixed values: sentences of license texts
SENTENCES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "permission to use", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("gpl", "free software", r"this program is free software[:;] you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("proprietary", "all rights reserved", r"all rights reserved\. unauthori[sz]ed copying of this (?:file|work)"),
    ("public-domain", "public domain", r"(?:released|dedicated|placed) (?:in|in?to) the public domain"),
)
# form of statement, priority (higher wins), confidence; {} is a license's names or identifier
BY_NAME = (
    (r"(?:licensed|distributed|released|available|published|covered|provided)(?: \w+)? under (?:the terms of )?(?:the |an? )?(?:{})\b", 3, 0.95),
    (r"(?:subject to|under|accept|see|read) the (?:terms of the )?(?:{}) (?:license|licence|terms|agreement)\b", 3, 0.9),
    (r"licen[cs]e(?:d under)?\s?[:=] ?[\"']?(?:the )?(?:{})\b", 3, 0.9),
    (r"(?:{}) (?:text|notice|file|header|terms)\b", 2, 0.7),
)
BY_IDENTIFIER = ((r"spdx-license-identifier: ?\(?(?:{})\b", 4, 1.0), (r"\(?\b(?:{})\b (?:or|and|with) [a-z0-9.-]+", 1, 0.4), (r"(?:license|licence)[\"']?\s?[:=]\s?[\"'](?:{})[\"']", 3, 0.95))
OWN_NAME = 2, 0.8        # a name alone, where it says license or licence


def stem(short: str) -> str:
    """The plain bytes that a short identifier begins with, or goes on with after a choice of names."""
    return re.match(r"(?:\(\?:[^)]*\))?([a-z0-9-]*)", short)[1]


def holds(low: bytes, keyword: bytes) -> bool:
    """Does the text hold every word of the keyword, or of one of those it offers?"""
    return any(all(word in low for word in words.split()) for words in keyword.split(b"|"))


@lru_cache(maxsize=1)
def rules() -> tuple:
    """(keyword, compiled pattern, label, priority, confidence): each form with each license, then links and sentences."""
    out = []

    def add(keyword, pattern, label, priority, sure):
        text = pattern.replace("[- ]", r"(?:-|\s+)").replace(" ?", r"\s*").replace(" ", r"\s+").encode()
        out.append((keyword.encode(), re.compile(rb"(?<![0-9a-z\x80-\xff])" + text), label, priority, sure))

    for label, keyword, names, short in LICENSES:
        for form, priority, sure in BY_NAME:
            add(keyword, form.format(names), label, priority, sure)
        several = re.split(r"\|(?![^(]*\))", names)
        named = [x for x in several if "licen" in x or "cc0" in x]
        if named and "mit" != label:
            add(keyword, f"(?:{names})\\b" if len(named) == len(several) else f"(?:{names})\\b(?= licen)", label, *OWN_NAME)
        for form, priority, sure in BY_IDENTIFIER:
            add("spdx" if form.startswith("spdx") else "licen" if "licen" in form else stem(short), form.format(short), label, priority, sure)
    for label, link in LINKS:
        add(".org/" if "/" in link else link.replace("\\", ""), r"(?:https?://)?(?:www\.)?" + link, label, 3, 0.9)
    for label, keyword, sentence in SENTENCES:
        add(keyword, sentence, label, 4, 1.0)
    return tuple(out)


def kept(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Drop each (start, end, priority, label, sure) that lies within one of higher priority, or within another of its
    own priority (of equal places the first in order of label stays). One sweep; a container always comes first."""
    reach: dict[int, int] = {}
    out = []
    for d in sorted(set(found), key=lambda d: (d[0], -d[1], -d[2], d[3])):
        if not any(end >= d[1] for p, end in reach.items() if p >= d[2]):
            out.append(d)
        reach[d[2]] = max(reach.get(d[2], -1), d[1])
    return out


WORD = np.array([c >= 128 or 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 for c in range(256)])
EDGE = rb"0-9a-z\x80-\xff"
BASE_PATTERNS = tuple((re.compile(b"(?<![" + EDGE + b"])" + (b"[^" + EDGE + b"]+").join(p.encode().split()) + b"(?![" + EDGE + b"])"), label) for p, label in PHRASES)


def scan_text(low: bytes) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, str, float]]]:
    """Base places (byte, label) and kept rule detections of one lower-cased text."""
    base = [(m.start(), label) for pattern, label in BASE_PATTERNS for m in pattern.finditer(low)] if b"license" in low else []
    has: dict[bytes, bool] = {}
    found = []
    for keyword, pattern, label, priority, sure in rules():
        if keyword not in has:
            has[keyword] = holds(low, keyword)
        if has[keyword]:
            found += [(m.start(), m.end(), priority, label, sure) for m in pattern.finditer(low)]
    return base, kept(found)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,end:long,label:string,priority:int>>"
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                 ("detections", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())])))])


def _scan(batches):
    keywords = sorted({r[0] for r in rules()} | {b"license"})
    for batch in batches:
        raw, ends = byte_view(batch.column(1))
        cols: dict[str, list] = {n: [] for n in OUT.names[1:]}
        for lo, hi in slices(ends):
            part = raw[ends[lo]:ends[hi]].tobytes().lower()
            bounds = (ends[lo:hi + 1] - ends[lo]).tolist()
            word = WORD[np.frombuffer(part, np.uint8)]
            first = word.copy()
            first[1:] &= ~word[:-1]
            at = np.array(bounds[:-1])
            at = at[at < len(part)]
            first[at] = word[at]
            upto = np.concatenate([[0], np.cumsum(first)])
            counts = upto[bounds[1:]] - upto[bounds[:-1]]
            live = any(holds(part, k) for k in keywords)
            for i in range(hi - lo):
                low = part[bounds[i]:bounds[i + 1]]
                base, found = scan_text(low) if live else ([], [])
                spots = [int(upto[bounds[i] + b] - upto[bounds[i]]) for b, _ in base]
                own = {label for _, label in base}
                cols["n_words"].append(int(counts[i]))
                cols["n_base"].append(len(base))
                cols["first_word"].append(min(spots, default=None))
                cols["last_word"].append(max(spots, default=None))
                cols["base_labels"].append(",".join(sorted(own)))
                cols["labels"].append(",".join(sorted(own | {d[3] for d in found})))
                cols["score"].append(max([d[4] for d in found] + [0.6] * bool(base), default=0.0))
                cols["detections"].append([{"start": d[0], "end": d[1], "label": d[3], "priority": d[2]} for d in found])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(cols[f.name], f.type) for f in OUT if f.name != "doc_id"]], schema=OUT)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, word and base phrase counts, labels, score (the surest detection) and the kept
    detections as byte ranges of the UTF-8 text. Null text is empty and has no labels (empty strings) and score 0;
    repeated rows are scanned alike; an empty table gives no rows; other columns are not looked at."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(_scan, SCHEMA)
