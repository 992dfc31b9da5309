"""License scans: template markup compiled into token automata."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.batches import chunks
from tidemark.session import table

# Base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Templates in markup, one list of templates to a label. <<opt>> ... <<end>> may be
# absent; <<var a|b c>> stands for any one of its alternatives; <<free n>> for up to n words of any kind,
# such as a holder's name; all other words are mandatory. First short notices, then whole texts.
TEMPLATES = {
    "mit-notice": [
        "<<var released|licensed|distributed|available>> under the <<opt>>terms of the<<end>> mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files <<opt>>the software<<end>> to deal in the software without restriction",
    ],
    "apache-2-notice": [
        "<<opt>>this <<var file|work|software|project>> is<<end>> <<var released|licensed|distributed>> under the"
        " <<opt>>terms of the<<end>> apache license version 2 <<opt>>0<<end>>",
    ],
    "gpl-3": [
        "<<opt>>this <<var work|program|software|file>> is<<end>> <<var released|licensed|distributed>> under the"
        " <<opt>>terms of the<<end>> gnu general public license <<opt>>as published by the free software foundation<<end>>"
        " <<opt>>either<<end>> version 3",
    ],
    "cc-by-nc-4": [
        "<<var released|licensed|distributed>> under <<opt>><<var a|the>><<end>> <<var cc by nc|creative commons attribution noncommercial>>"
        " <<opt>>license<<end>> 4 0 <<opt>>international<<end>>",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted"
        " provided that the following conditions are met",
    ],
    "mit-text": [
        "<<opt>>copyright <<free 20>><<end>> permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files the software to deal in the software without restriction including without limitation the"
        " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom"
        " the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice"
        " <<opt>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software the software"
        " is provided as is without warranty of any kind express or implied including but not limited to the warranties of"
        " merchantability fitness for a particular purpose and <<var noninfringement|non infringement>> in no event shall the authors or"
        " copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"
        " arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "isc-text": [
        "<<opt>>copyright <<free 20>><<end>> permission to use copy modify and <<opt>>or<<end>> distribute this software for any purpose"
        " with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and the author disclaims all warranties with regard to this software including all implied"
        " warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or"
        " consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract"
        " negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ],
    "bsd-2-text": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
        " conditions are met <<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of"
        " conditions and the following disclaimer <<opt>>2<<end>> redistributions in binary form must reproduce the above copyright"
        " notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the"
        " distribution this software is provided by <<free 12>> as is and any express or implied warranties including but not limited"
        " to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<free 12>>"
        " be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to"
        " procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any"
        " theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of"
        " the use of this software even if advised of the possibility of such damage",
    ],
    "bsd-3-text": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
        " conditions are met <<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of"
        " conditions and the following disclaimer <<opt>>2<<end>> redistributions in binary form must reproduce the above copyright"
        " notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the"
        " distribution <<opt>>3<<end>> neither the name of <<free 12>> nor the names of its contributors may be used to endorse or"
        " promote products derived from this software without specific prior written permission this software is provided by <<free 12>>"
        " as is and any express or implied warranties including but not limited to the implied warranties of merchantability and"
        " fitness for a particular purpose are disclaimed in no event shall <<free 12>> be liable for any direct indirect incidental"
        " special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of"
        " use data or profits or business interruption however caused and on any theory of liability whether in contract strict"
        " liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the"
        " possibility of such damage",
    ],
    "apache-2-header": [
        "licensed under the apache license version 2 0 the license you may not use this <<var file|work|software>> except in compliance"
        " with the license you may obtain a copy of the license at <<var http|https>> www apache org licenses license 2 0 unless required"
        " by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without"
        " warranties or conditions of any kind either express or implied see the license for the specific language governing"
        " permissions and limitations under the license",
    ],
    "mpl-2-header": [
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with"
        " this file you can obtain one at <<var http|https>> mozilla org mpl 2 0",
    ],
    "gpl-or-later": [
        "<<var this program|this file|this library>> is free software you can redistribute it and or modify it under the terms"
        " of the gnu general public license as published by the free software foundation either version <<var 2|3>> of the license or at"
        " your option any later version <<var this program|this file|this library>> is distributed in the hope that it will be useful but"
        " without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu"
        " general public license for more details",
    ],
}

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """Token automaton of one template: ``step[state]`` maps a token to further states."""

    def __init__(self, markup: str):
        self.step: list[dict[bytes, list[int]]] = []
        self.skip: list[list[int]] = []
        self.any: list[list[int]] = []
        self.first = self._state()
        self.last = self._sequence(re.findall(r"<<[^>]*>>|[^\s<>]+", markup), self.first)

    def _state(self) -> int:
        self.step.append({})
        self.skip.append([])
        self.any.append([])
        return len(self.step) - 1

    def _words(self, words: list[str], at: int) -> int:
        for w in words:
            to = self._state()
            self.step[at].setdefault(w.encode(), []).append(to)
            at = to
        return at

    def _sequence(self, items: list[str], at: int) -> int:
        opened = []
        for item in items:
            if item == "<<opt>>":
                opened.append(at)
            elif item == "<<end>>":
                self.skip[opened.pop()].append(at)
            elif item.startswith("<<free "):
                chain = [at]
                for _ in range(int(item[7:-2])):
                    to = self._state()
                    self.any[chain[-1]].append(to)
                    chain.append(to)
                for state in chain[:-1]:  # fewer words will do
                    self.skip[state].append(chain[-1])
                at = chain[-1]
            elif item.startswith("<<var "):
                to = self._state()
                for option in item[6:-2].split("|"):
                    self.skip[self._words(option.split(), at)].append(to)
                at = to
            else:
                at = self._words([item], at)
        if opened:
            raise ValueError("an optional region is not closed")
        return at

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def starts(self) -> set[bytes]:
        return {w for s in self._closed({self.first}) for w in self.step[s]}

    def accepts(self, words: list[bytes], at: int) -> int:
        """The end of the longest match that begins at word ``at``, or -1."""
        now, end = self._closed({self.first}), -1
        for i in range(at, len(words)):
            now = self._closed({t for s in now for t in (*self.step[s].get(words[i], ()), *self.any[s])})
            if not now:
                break
            if self.last in now:
                end = i + 1
        return end


@lru_cache(1)
def compiled() -> tuple[dict[bytes, list[tuple[list[bytes], str]]], dict[bytes, list[tuple[Automaton, str]]]]:
    """Phrases and automata by the words they can begin with."""
    phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for phrase, label in PHRASES.items():
        words = phrase.encode().split()
        phrases.setdefault(words[0], []).append((words, label))
    automata: dict[bytes, list[tuple[Automaton, str]]] = {}
    for label, templates in TEMPLATES.items():
        for a in map(Automaton, templates):
            for w in a.starts():
                automata.setdefault(w, []).append((a, label))
    return phrases, automata


def scan_text(text: str) -> tuple:
    phrases, automata = compiled()
    words = WORD.findall(text.encode("utf-8", "surrogatepass").lower())  # of bytes, lower() knows A-Z alone
    places, base, more, spans = [], set(), set(), []
    for i, w in enumerate(words):
        for phrase, label in phrases.get(w, ()):
            if words[i : i + len(phrase)] == phrase:
                places.append(i)
                base.add(label)
        for automaton, label in automata.get(w, ()):
            if (end := automaton.accepts(words, i)) >= 0:
                more.add(label)
                spans.append({"label": label, "first": i, "end": end})
    labels = sorted(base | more)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), 1.0 - 0.5 ** len(labels), spans


MADE = {"n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}
SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with phrase places, labels, a score and the ``spans`` of accepted templates.

    Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. ``n_base``
    counts all places of base phrases, ``first_word``/``last_word`` are the smallest and largest (null
    without any). ``labels`` holds base and template labels; ``score`` is 0 without labels, then
    1 - 2^-labels. A null or empty text has no words and no labels (empty strings). Columns of
    these names are replaced, others kept; repeated rows have repeated results; an empty table
    gives an empty one.
    """
    made = MADE | {"spans": "array<struct<label:string,first:bigint,end:bigint>>"}
    source = docs.drop(*[c for c in made if c != text])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + "".join(f", {n} {t}" for n, t in made.items())
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), SPANS]
    names = source.columns + list(made)

    def run(batches):
        for part, texts in chunks(batches, text):
            found = list(zip(*map(scan_text, texts)))
            yield pa.RecordBatch.from_arrays(list(part.columns) + [pa.array(v, t) for v, t in zip(found, types)], names=names)

    return source.mapInArrow(run, schema)


def op8_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *MADE)


def pattern(markup: str) -> str:
    """A template as a regular expression over a text of words that each stand between two spaces."""
    out = []
    for item in re.findall(r"<<[^>]*>>|[^\s<>]+", markup):
        if item == "<<opt>>":
            out.append("(?:")
        elif item == "<<end>>":
            out.append(")?")
        elif item.startswith("<<free "):
            out.append(f"(?: [^ ]+ ){{0,{item[7:-2]}}}")
        elif item.startswith("<<var "):
            out.append("(?:" + "|".join("".join(f" {w} " for w in o.split()) for o in item[6:-2].split("|")) + ")")
        else:
            out.append(f" {item} ")
    return "".join(out)


OP8_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), p as (
  select doc_id, w, len(w)::bigint as n_words, ' ' || array_to_string(w, '  ') || ' ' as t,
    list_filter(range(len(w)), lambda i: w[i+1] = 'under' and w[i+2] = 'the' and w[i+3] = 'mit' and w[i+4] = 'license') as mit,
    list_filter(range(len(w)), lambda i: w[i+1] = 'apache' and w[i+2] = 'license' and w[i+3] = 'version' and w[i+4] = '2') as apache,
    list_filter(range(len(w)), lambda i: w[i+1] = 'cc' and w[i+2] = 'by' and w[i+3] = 'nc') as ccnc
  from w
), l as (
  select *, list_concat(list_concat(mit, apache), ccnc) as places,
    list_filter([case when len(apache) > 0 then 'apache-2' end, case when len(ccnc) > 0 then 'cc-by-nc' end, case when len(mit) > 0 then 'mit' end], lambda x: x is not null) as base,
    list_filter([
      case when regexp_matches(t, ' (released|licensed|distributed|available)  under  the (?: terms  of  the )? mit  license ')
        or regexp_matches(t, ' permission  is  hereby  granted  free  of  charge  to  any  person  obtaining  a  copy  of  this  software  and  associated  documentation  files (?: the  software )? to  deal  in  the  software  without  restriction ') then 'mit-notice' end,
      case when regexp_matches(t, ' (released|licensed|distributed)  under  the (?: terms  of  the )? apache  license  version  2 ') then 'apache-2-notice' end,
      case when regexp_matches(t, ' (released|licensed|distributed)  under  the (?: terms  of  the )? gnu  general  public  license (?: as  published  by  the  free  software  foundation )?(?: either )? version  3 ') then 'gpl-3' end,
      case when regexp_matches(t, ' (released|licensed|distributed)  under (?: (?:a|the) )?(?: cc  by  nc | creative  commons  attribution  noncommercial )(?: license )? 4  0 ') then 'cc-by-nc-4' end,
      case when regexp_matches(t, ' redistribution  and  use  in  source  and  binary  forms  with  or  without  modification  are  permitted  provided  that  the  following  conditions  are  met ') then 'bsd' end,
      {texts}
    ], lambda x: x is not null) as more
  from p
)
select doc_id, n_words, len(places)::bigint as n_base, list_min(places)::bigint as first_word, list_max(places)::bigint as last_word,
  array_to_string(list_sort(base), ',') as base_labels, array_to_string(list_sort(list_concat(base, more)), ',') as labels,
  1::double - pow(0.5::double, len(base) + len(more)) as score
from l
""".replace("{texts}", ",\n      ".join(f"case when regexp_matches(t, '{pattern(m)}') then '{label}' end" for label, (m, *_) in TEMPLATES.items() if label.endswith(("-text", "-header", "-later"))))
