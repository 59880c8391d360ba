"""Licence scans by sentence rules, in DataFrame functions only.

A text's sentences are normalised and mapped to the identifiers of known licence sentences; the sequence of identifiers is
then matched against ordered licence rules. What a rule has matched is taken out of the sequence before the next rule. A tag
such as "SPDX-License-Identifier: (MIT OR Apache-2.0)" is one identifier for each licence that it names, and so is a statement that only
names licences, "Dual licensed under MIT and Apache-2.0" or "License: GPLv3". "Licence" is read as "license".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import read

#: A sentence without one of these is no licence sentence.
HINT = "licen[cs]e|all rights|copyright|warrant|permission|redistribut|spdx|public domain|as is|copyleft|endorse|[(]c[)]|gpl|cc0|cc by|cc-by|fee is hereby|liable|misrepresented|want to"
_BY = "(.* )?(licensed|released|distributed|available|published|provided|covered|redistribute it and or modify it) (under|by) (the )?(terms of )?(the )?(a )?"
_GPL = "(gnu general public license|gnu gpl|gpl)"
_LGPL = "(gnu (lesser|library) general public license|gnu lgpl|lgpl)"
_AGPL = "(gnu affero general public license|gnu agpl|agpl)"
_CC = "(.* )?(licensed|released|distributed|available|published|provided) under (a |the )?"
_CC_END = "( [0-9.]+.*| license.*| international.*)?"
#: Identifier and pattern of the whole normalised sentence (lower case; other characters than letters, digits, dot, plus and minus are one space). Order counts.
SENTENCES = (
    ("Copyright", "(copyright( c)?|c) ([0-9]{4}.*|.* [0-9]{4}.*)"),
    ("AllRights", "all rights reserved"),
    ("AfferoPlus", f"{_BY}{_AGPL}.*(later version|or later|[+]).*"),
    ("AfferoVer", f"{_BY}{_AGPL}.*"),
    ("LesserVer3Plus", f"{_BY}{_LGPL}.*(version |v|-)3.*(later version|or later|[+]).*"),
    ("LesserVer2Plus", f"{_BY}{_LGPL}.*(version |v|-)2.*(later version|or later|[+]).*"),
    ("LesserVer3", f"{_BY}{_LGPL}.*(version |v|-)3.*"),
    ("LesserVer2", f"{_BY}{_LGPL}.*(version |v|-)2.*"),
    ("LesserVer", f"{_BY}{_LGPL}.*"),
    ("GplVer3Plus", f"{_BY}{_GPL}.*(version |v|-)3.*(later version|or later|[+]).*"),
    ("GplVer2Plus", f"{_BY}{_GPL}.*(version |v|-)2.*(later version|or later|[+]).*"),
    ("GplVer3", f"{_BY}{_GPL}.*(version |v|-)3.*"),
    ("GplVer2", f"{_BY}{_GPL}.*(version |v|-)2.*"),
    ("GplAny", f"{_BY}{_GPL}.*"),
    ("GplHope", "(this|the|it) .*distributed in the hope that it will be useful but without any warranty.*"),
    ("GplDetails", "see the gnu (lesser |library |affero )?general public license for more details"),
    ("GplCopy", "you should have received a copy of the gnu (lesser |library |affero )?general public license.*"),
    ("AgplTitle", "gnu affero general public license( version 3.*)?"),
    ("LgplTitle", "gnu (lesser|library) general public license( version [23].*)?"),
    ("GplTitle", "gnu general public license( version [23].*)?"),
    ("ApacheBy", f"{_BY}apache( software)? license( version| v)? ?2[.]0.*"),
    ("ApacheTitle", "(the )?apache license( version 2[.]0)?( january 2004)?"),
    ("ApacheUse", "you may not use this (file|work|software) except in compliance with the license"),
    ("ApacheObtain", "you may obtain a copy of the license at.*"),
    ("ApacheUnless", "unless required by applicable law or agreed to in writing .* as is basis without warranties or conditions of any kind.*"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("MitBy", f"{_BY}mit license( .*)?"),
    ("MitTitle", "(the )?mit license( mit)?"),
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy.*"),
    ("MitNotice", "the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies.*"),
    ("MitAsIs", "the software is provided as is without warranty of any kind.*"),
    ("MitLiable", "in no event shall the (authors or copyright holders|author) be liable.*"),
    ("IscTitle", "(the )?isc license( isc)?"),
    ("IscBy", f"{_BY}isc license( .*)?"),
    ("IscGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided.*"),
    ("ZeroGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("IscAsIs", "the software is provided as is and the author disclaims all warranties.*"),
    ("IscLiable", "in no event shall the author be liable for any special direct indirect or consequential damages.*"),
    ("Bsd3By", f"{_BY}(new |modified |revised |3-clause |three-clause )bsd( 3-clause)? license( .*)?|{_BY}bsd 3-clause.*"),
    ("Bsd2By", f"{_BY}(simplified |freebsd |2-clause |two-clause )(bsd )?(2-clause )?license( .*)?|{_BY}bsd 2-clause.*"),
    ("BsdBy", f"{_BY}(a )?bsd(-style)? license( .*)?"),
    ("BsdGrant", "redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("BsdSource", "([0-9][.] |- |[*] )?redistributions of source code must retain the above copyright notice.*"),
    ("BsdBinary", "([0-9][.] |- |[*] )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("BsdAdvert", "([0-9][.] |- )?all advertising materials mentioning features or use of this software must display.*"),
    ("BsdEndorse", "([0-9][.] |- )?neither the name.* may be used to endorse or promote products.*"),
    ("BsdAsIs", "this software is provided by the (copyright holders|author|regents|university).* as is .*"),
    ("BsdLiable", "in no event shall the (copyright (holder|owner)s?|regents|author).* be liable for any direct indirect incidental.*"),
    ("MplBy", "this source code form is subject to the terms of the mozilla public license v ?2[.]0"),
    ("MplUnder", f"{_BY}mozilla public license.*2[.]0.*"),
    ("EplUnder", f"{_BY}eclipse public license.*2[.]0.*"),
    ("EplOneUnder", f"{_BY}eclipse public license.*1[.]0.*"),
    ("EuplUnder", f"{_BY}(european union public license|eupl).*"),
    ("BoostUnder", f"{_BY}boost software license.*"),
    ("BoostTitle", "boost software license( -)? version 1[.]0.*"),
    ("ArtisticUnder", f"{_BY}artistic license 2[.]0.*"),
    ("OflUnder", "(.* )?licensed under the sil open font license.*"),
    ("ZlibWarranty", "this software is provided as-is without any express or implied warranty"),
    ("ZlibGrant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely.*"),
    ("ZlibOrigin", "([0-9][.] )?the origin of this software must not be misrepresented.*"),
    ("ZlibBy", f"{_BY}zlib license( .*)?"),
    ("Wtfpl", "(.* )?do what the fuck you want to public license.*"),
    ("CcZero", "(.* )?(licensed|released|dedicated|available) (under|to) (the )?(cc0|creative commons zero).*"),
    ("CcByNcSa", f"{_CC}(cc[ -]by-nc-sa|creative commons attribution-noncommercial-sharealike){_CC_END}"),
    ("CcByNcNd", f"{_CC}(cc[ -]by-nc-nd|creative commons attribution-noncommercial-noderivatives){_CC_END}"),
    ("CcByNc", f"{_CC}(cc[ -]by-nc|creative commons attribution-noncommercial){_CC_END}"),
    ("CcBySa", f"{_CC}(cc[ -]by-sa|creative commons attribution-sharealike){_CC_END}"),
    ("CcByNd", f"{_CC}(cc[ -]by-nd|creative commons attribution-noderivatives){_CC_END}"),
    ("CcBy", f"{_CC}(cc[ -]by|creative commons attribution){_CC_END}"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("PublicDomain", "(.* )?(is|are|released|placed|dedicated) (in|into|to) the public domain"),
    ("Unknown", "(.* )?(licensed|released|distributed) under .*licen[cs]e.*"),
)
_GNU = "(<GplHope>)?(<GplDetails>)?(<GplCopy>)?"
_NOTICE = "(<Copyright>)*(<AllRights>)?"
#: Licence and pattern of identifiers, each in angle brackets. The first rules are the most specific ones.
RULES = (
    ("AGPL-3.0-or-later", f"<AfferoPlus>{_GNU}"),
    ("AGPL", f"<AfferoVer>{_GNU}|<AgplTitle>"),
    ("LGPL-3.0-or-later", f"<LesserVer3Plus>{_GNU}"),
    ("LGPL-2.1-or-later", f"<LesserVer2Plus>{_GNU}"),
    ("LGPL-3.0-only", f"<LesserVer3>{_GNU}"),
    ("LGPL-2.1-only", f"<LesserVer2>{_GNU}"),
    ("LGPL", f"<LesserVer>{_GNU}|<LgplTitle>"),
    ("GPL-3.0-or-later", f"<GplVer3Plus>{_GNU}"),
    ("GPL-2.0-or-later", f"<GplVer2Plus>{_GNU}"),
    ("GPL-3.0-only", f"<GplVer3>{_GNU}"),
    ("GPL-2.0-only", f"<GplVer2>{_GNU}"),
    ("GPL", f"<GplAny>{_GNU}|<GplTitle>"),
    ("Apache-2.0", "<ApacheBy>(<ApacheUse>)?(<ApacheObtain>)?(<ApacheUnless>)?(<ApacheSee>)?"),
    ("Apache-2.0", "<ApacheTitle>|<ApacheUse><ApacheObtain>"),
    ("MIT", f"(<MitTitle>)?{_NOTICE}<MitGrant>(<MitNotice>)?<MitAsIs>(<MitLiable>)?"),
    ("MIT", "<MitBy>|<MitTitle>"),
    ("ISC", f"(<IscTitle>)?{_NOTICE}<IscGrant>(<IscAsIs>)?(<IscLiable>)?|<IscBy>|<IscTitle>"),
    ("0BSD", "<ZeroGrant>(<IscAsIs>)?(<IscLiable>)?"),
    ("BSD-4-Clause", "<BsdGrant><BsdSource><BsdBinary><BsdAdvert><BsdEndorse>(<BsdAsIs>)?(<BsdLiable>)?"),
    ("BSD-3-Clause", "<BsdGrant><BsdSource><BsdBinary><BsdEndorse>(<BsdAsIs>)?(<BsdLiable>)?|<Bsd3By>"),
    ("BSD-2-Clause", "<BsdGrant><BsdSource><BsdBinary>(<BsdAsIs>)?(<BsdLiable>)?|<Bsd2By>"),
    ("BSD", "<BsdBy>"),
    ("MPL-2.0", "<MplBy>|<MplUnder>"),
    ("EPL-2.0", "<EplUnder>"),
    ("EPL-1.0", "<EplOneUnder>"),
    ("EUPL", "<EuplUnder>"),
    ("BSL-1.0", "<BoostUnder>|<BoostTitle>"),
    ("Artistic-2.0", "<ArtisticUnder>"),
    ("OFL", "<OflUnder>"),
    ("Zlib", "<ZlibWarranty>(<MitLiable>)?<ZlibGrant>(<ZlibOrigin>)?|<ZlibGrant>|<ZlibBy>"),
    ("WTFPL", "<Wtfpl>"),
    ("CC0-1.0", "<CcZero>"),
    ("CC-BY-NC-SA", "<CcByNcSa>"),
    ("CC-BY-NC-ND", "<CcByNcNd>"),
    ("CC-BY-NC", "<CcByNc>"),
    ("CC-BY-SA", "<CcBySa>"),
    ("CC-BY-ND", "<CcByNd>"),
    ("CC-BY", "<CcBy>"),
    ("Unlicense", "<Unlicense>"),
    ("Public-Domain", "<PublicDomain>"),
)
#: Licences that a tag may name.
TAGS = (
    "MIT MIT-0 Apache-1.1 Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD ISC Zlib Unlicense WTFPL CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 "
    "CC-BY-NC-ND-4.0 CC-BY-ND-4.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-1.1 "
    "MPL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 BSL-1.0 Artistic-2.0 OFL-1.1 PostgreSQL Python-2.0 CDDL-1.0 MS-PL"
).split()
#: Tag in lower case -> licence; the older forms of the GNU tags mean the same as "-only" and "-or-later".
TAG_OF = {t.lower(): t for t in TAGS}
TAG_OF |= {t.lower().removesuffix("-only"): t for t in TAGS if t.endswith("-only")} | {t.lower().removesuffix("-or-later") + "+": t for t in TAGS if t.endswith("-or-later")}
_TAG = "^spdx-license-identifier .+$"
_NAMED = f"^(the )?licen[cs]e (is |under )?(the )?({'|'.join(sorted(t.replace('.', '[.]').replace('+', '[+]') for t in TAG_OF))})$"
#: Names of licences in a statement, with the tag that each stands for; the first that fits counts.
_VERSION = "( version)?(( )?v| |-)?"
_LATER = "([+]| or later| or any later version|-or-later)?"
NAMES = (
    "mit( license)?", f"apache( software)?( license)?{_VERSION}2([.]0)?", "((new|modified|revised) )?(bsd( |-)3-clause|3-clause bsd)( license)?", "((simplified) )?(bsd( |-)2-clause|2-clause bsd)( license)?",
    f"(gnu )?(agpl|affero general public license){_VERSION}3([.]0)?{_LATER}", f"(gnu )?(lgpl|lesser general public license){_VERSION}(2[.]1|3([.]0)?){_LATER}", f"(gnu )?(gpl|general public license){_VERSION}[23]([.]0)?{_LATER}",
    f"(mpl|mozilla public license){_VERSION}2([.]0)?", f"(epl|eclipse public license){_VERSION}2([.]0)?", "cc0( 1[.]0)?", "(cc|creative commons)( |-)by(-nc-sa|-nc-nd|-nc|-sa|-nd)?( |-)[34][.]0", "isc( license)?", "zlib( license)?", "unlicense",
)
TAG_BY_NAME = (
    ("mit", "mit"), ("apache", "apache-2.0"), (".*3-clause", "bsd-3-clause"), (".*2-clause", "bsd-2-clause"), (".*(agpl|affero).*(later|[+])", "agpl-3.0-or-later"), (".*(agpl|affero)", "agpl-3.0-only"),
    (".*(lgpl|lesser).*2[.]1.*(later|[+])", "lgpl-2.1-or-later"), (".*(lgpl|lesser).*2[.]1", "lgpl-2.1-only"), (".*(lgpl|lesser).*(later|[+])", "lgpl-3.0-or-later"), (".*(lgpl|lesser)", "lgpl-3.0-only"),
    (".*(gpl|general).*2.*(later|[+])", "gpl-2.0-or-later"), (".*(gpl|general).*2", "gpl-2.0-only"), (".*(gpl|general).*(later|[+])", "gpl-3.0-or-later"), (".*(gpl|general)", "gpl-3.0-only"), ("m", "mpl-2.0"), ("(epl|eclipse)", "epl-2.0"), ("cc0", "cc0-1.0"),
    *((f".*by{k}[ -]+{v}", f"cc-by{k}-{v}.0") for k in ("-nc-sa", "-nc-nd", "-nc", "-sa", "-nd", "") for v in "34"), ("isc", "isc"), ("zlib", "zlib"), ("unlicense", "unlicense"),
)
_ONE = f"({'|'.join(NAMES)})"
_STATED = f"^(((.* )?(licensed|released|distributed|available|published|provided|covered) (under|by|with) |(this|the) [a-z]+ (is|are) |licenses? (is |are )?|it is )?(either of |both |one of |any of )?((the )?(terms|conditions) of )?(the |a )*)(either )?{_ONE}( (and|or|and or)( the)? {_ONE})*( licen[cs]ed?s?)?( at your option| see .*| - .*)?$"
#: The names of a statement, in a text whose spaces are doubled so that neighbours don't share one.
_EACH = f" ({_ONE.replace(' ', '  ')}) "
_NO_TAG = ("spdx-license-identifier", "license", "licence", "the", "is", "under", "and", "or", "with", "")
#: Pattern and replacement, in order: signs, versions and tags that hold a mark, lines that go on in the next one (comment signs left out), ends of sentences.
STEPS = (
    ("©", "(c)"),
    ("(?i)\\bv[.][ \\t]*([0-9])", "v$1"),
    ("(?i)(identifier|licen[cs]e)[ \\t]*:[ \\t]*", "$1 "),
    (";[ \\t\\r]*\\n[ \\t#*/;-]*(either|or|and)\\b", "; $1"),
    ("([^.!?;:\\n])[ \\t\\r]*\\n[ \\t#*/;-]*([a-z]|[(]at )", "$1 $2"),
    ("(,|[^\\n]{50}[^.!?;:\\n])[ \\t\\r]*\\n[ \\t#*/;-]*([A-Za-z0-9\"'(])", "$1 $2"),
    ("\\b(the|of|by|under|or|and|to|a|an|with|in|for)[ \\t\\r]*\\n[ \\t#*/;-]*([A-Z0-9\"'(])", "$1 $2"),
    ("([.!?])[ \\t\\r]+", "$1\n"),
)
_OTHER = "[^a-z0-9.+-]+"
_EDGE = "^[ .+-]+|[ .-]+$"
#: Identifiers that say nothing if no rule takes them.
_SILENT = "<(Copyright|AllRights|Gpl[A-Z][a-z]+|Apache[A-Z][a-z]+)>"


def _identifiers(text: Column) -> Column:
    """The identifiers of a text's licence sentences, in order."""
    for pattern, new in STEPS:
        text = F.regexp_replace(text, pattern, new)
    likely = F.filter(F.transform(F.split(text, "\n"), F.lower), lambda s: s.rlike(HINT))
    plain = F.transform(likely, lambda s: F.replace(F.regexp_replace(F.regexp_replace(s, _OTHER, " "), _EDGE, ""), F.lit("licence"), F.lit("license")))

    def known(s: Column) -> Column:
        found = F.lit(None).cast("string")
        for name, pattern in reversed(SENTENCES):
            found = F.when(s.rlike(f"^({pattern})$"), F.lit(name)).otherwise(found)
        tags = F.transform(F.filter(F.split(s, " "), lambda x: ~x.isin(*_NO_TAG)), lambda x: F.concat(F.lit("Tag:"), x))
        names = F.regexp_extract_all(F.concat(F.lit(" "), F.replace(s, F.lit(" "), F.lit("  ")), F.lit(" ")), F.lit(_EACH), 1)
        return F.when(s.rlike(_TAG) | s.rlike(_NAMED), tags).when(s.rlike(_STATED) & ((F.size(names) > 1) | F.coalesce(found == "Unknown", F.lit(True))), F.transform(names, named)).otherwise(F.array(found))

    def named(name: Column) -> Column:
        tag = F.lit(None).cast("string")
        for pattern, t in reversed(TAG_BY_NAME):
            tag = F.when(name.rlike(f"^{pattern}"), F.lit(f"Tag:{t}")).otherwise(tag)
        return tag

    return F.array_compact(F.flatten(F.transform(plain, known)))


def _licenses(sequence: Column) -> Column:
    """Applies the rules in order to "<A><B><C>": struct(rest, found)."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("pattern")) for name, pattern in RULES])
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        rest = F.regexp_replace(state["rest"], rule["pattern"], F.lit(""))
        return F.struct(rest.alias("rest"), F.when(rest != state["rest"], F.concat(state["found"], F.array(rule["name"]))).otherwise(state["found"]).alias("found"))

    return F.aggregate(rules, start, step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_sentences, sentences ("A;B;"), licenses (each once, in the rules' order and then the tags', comma-joined), unmatched.

    Copyright and rights notices are sentences but no licences. Null, empty and licence-free texts give 0 and empty strings;
    long texts are read whole; repeated rows give repeated rows; an empty table gives an empty one. Other columns are not
    read, so their names may clash. Everything is row-local: no shuffle, whatever the skew.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = F.when(F.lower(text).rlike(HINT + "|©"), _identifiers(text)).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col), ids.alias("ids"))
    tags = F.map_from_arrays(F.array(*[F.lit(f"Tag:{t}") for t in TAG_OF]), F.array(*[F.lit(n) for n in TAG_OF.values()]))
    named = F.array_compact(F.transform("ids", lambda x: F.try_element_at(tags, x)))
    untagged = F.filter("ids", lambda x: F.try_element_at(tags, x).isNull())
    join = lambda xs, left, right: F.array_join(F.transform(xs, lambda x: F.concat(F.lit(left), x, F.lit(right))), "")
    rows = rows.select(id_col, F.size("ids").cast("long").alias("n_sentences"), join("ids", "", ";").alias("sentences"), named.alias("named"), join(untagged, "<", ">").alias("left"))
    rows = rows.select("*", F.when(F.col("left") != "", _licenses(F.col("left"))).alias("state"))
    rest = F.regexp_replace(F.coalesce(F.col("state.rest"), F.lit("")), _SILENT, "")
    found = F.array_distinct(F.concat(F.coalesce("state.found", F.array().cast("array<string>")), "named"))
    return rows.select(id_col, "n_sentences", "sentences", F.array_join(found, ",").alias("licenses"), F.regexp_replace(rest, "<([^>]*)>", "$1;").alias("unmatched"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("\\n", "\n").replace("\\t", "\t").replace("\\r", "\r").replace("'", "''") + "'"
    known = "CASE " + " ".join(f"WHEN regexp_matches(s, {q(f'^({p})$')}) THEN {q(n)}" for n, p in SENTENCES) + " END"
    tag = "CASE " + " ".join(f"WHEN regexp_matches(x, {q(f'^{p}')}) THEN {q(f'Tag:{t}')}" for p, t in TAG_BY_NAME) + " END"
    names = f"regexp_extract_all(' ' || replace(s, ' ', '  ') || ' ', {q(_EACH)}, 1)"
    known = f"CASE WHEN regexp_matches(s, {q(_TAG)}) OR regexp_matches(s, {q(_NAMED)}) THEN list_transform(list_filter(string_split(s, ' '), lambda x: x NOT IN ({', '.join(map(q, _NO_TAG))})), lambda x: 'Tag:' || x) WHEN regexp_matches(s, {q(_STATED)}) AND (len({names}) > 1 OR coalesce({known}, 'Unknown') = 'Unknown') THEN list_transform({names}, lambda x: {tag}) ELSE [{known}] END"
    text = "coalesce(text, '')"
    for pattern, new in STEPS:
        text = f"regexp_replace({text}, {q(pattern)}, {q(new.replace('$', chr(92)))}, 'g')"
    tags = "MAP {" + ", ".join(f"'Tag:{t}': '{n}'" for t, n in TAG_OF.items()) + "}"
    steps, last = [], "seq"
    for k, (name, pattern) in enumerate(RULES):
        new = f"regexp_replace(rest, {q(pattern)}, '', 'g')"
        steps.append(f"r{k} AS (SELECT doc_id, n_sentences, sentences, named, {new} AS rest, CASE WHEN {new} <> rest AND NOT list_contains(found, {q(name)}) THEN list_append(found, {q(name)}) ELSE found END AS found FROM {last})")
        last = f"r{k}"
    return f"""
WITH lines AS (SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), {q(HINT + '|©')}) THEN string_split({text}, chr(10)) ELSE [] END AS ls FROM documents),
plain AS (SELECT doc_id, list_transform(list_filter(list_transform(ls, lambda x: lower(x)), lambda x: regexp_matches(x, {q(HINT)})), lambda x: replace(regexp_replace(regexp_replace(x, '{_OTHER}', ' ', 'g'), '{_EDGE}', '', 'g'), 'licence', 'license')) AS ls FROM lines),
ids AS (SELECT doc_id, list_filter(flatten(list_transform(ls, lambda s: {known})), lambda x: x IS NOT NULL) AS ids FROM plain),
seq AS (SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(list_transform(ids, lambda x: x || ';'), ''), '') AS sentences,
  list_filter(list_transform(ids, lambda x: {tags}[x]), lambda x: x IS NOT NULL) AS named, coalesce(array_to_string(list_transform(list_filter(ids, lambda x: {tags}[x] IS NULL), lambda x: '<' || x || '>'), ''), '') AS rest, []::VARCHAR[] AS found FROM ids),
{", ".join(steps)},
done AS (SELECT *, list_concat(found, named) AS everything FROM {last})
SELECT doc_id, n_sentences, sentences, coalesce(array_to_string(list_filter(everything, lambda x, i: list_position(everything, x) = i), ','), '') AS licenses, regexp_replace(regexp_replace(rest, '{_SILENT}', '', 'g'), '<([^>]*)>', '\\1;', 'g') AS unmatched FROM done
"""


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


SQL = _sql()
