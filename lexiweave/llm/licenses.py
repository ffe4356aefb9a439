"""License scans: a trained paragraph classifier, confirmed against templates.

A multinomial logistic regression over binary word unigrams and bigrams is fitted, with
an L2 penalty, to the notices in TEMPLATES, to variants of them with words left out, to
paragraphs that only use such words (OTHER) and to ordinary prose (PROSE). Scoring is SQL.
Every line and window of every text is judged, whatever words it has: its weights are added
up in place, and where some family is likelier than unknown (no other can be known) it is
exploded to its n-grams, joined with the weights (a few thousand rows, fixed by the notices)
and summed. A temperature calibrates the probabilities; it is fitted to models
that saw neither a notice nor its variants. A probability below THRESHOLD is unknown. The predicted family counts as
confirmed if the line or window holds CONFIRM of the n-grams of one of its templates.

Paragraphs are split at blank lines; a line of comment signs alone is blank. Scored are
the single lines of up to two SPAN words and, over line ends and in longer lines, overlapping windows of words, so
hard-wrapped notices are judged whole. Windows leave out confirmed lines. A window counts if its family is confirmed, or if
no single line in it has a licence. Null and empty texts have none. Repeated rows are scanned each.
A paragraph without a known licence counts as unknown if it has a cue word, and not at all if it has none.
Of equal probabilities the first family in order of names wins. An empty table gives no
rows. A text of any length is one value of its column. Other columns are not read.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Family -> usual short notices: fixed values.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "This project is released under the Apache 2.0 license.", "Apache License Version 2.0, January 2004", "Distributed under the Apache License 2.0; see the LICENSE file for details.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, either express or implied.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Use of this source code is governed by a BSD-style license.", "Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "This software is distributed under the 2-clause BSD license.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the new BSD license.", "This code is available under the simplified BSD license."],
    "cc_by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Content is available under the Creative Commons Attribution License.", "This article is distributed under the terms of the Creative Commons Attribution 4.0 International License (CC BY 4.0).", "Except where otherwise noted, content on this site is licensed under a CC BY 3.0 license.", "You are free to share and adapt the material as long as you give appropriate credit (CC BY).", "Published under CC-BY 4.0."],
    "cc_by_nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Shared under CC BY-NC-SA 4.0 for noncommercial use only.", "This is an open access article under the CC BY-NC license for non-commercial use.", "Available under the Creative Commons Attribution-NonCommercial 3.0 license.", "You may not use the material for commercial purposes (CC BY-NC 4.0).", "Published under CC-BY-NC-ND 4.0."],
    "cc_by_sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.", "Available under the Creative Commons Attribution-ShareAlike 3.0 Unported license.", "If you remix the material you must distribute your contributions under the same license (CC BY-SA).", "Content is licensed under CC BY-SA 3.0 unless otherwise noted.", "Published under CC-BY-SA 4.0."],
    "cc0": ["Released under CC0 1.0 Universal.", "This work is dedicated to the public domain under CC0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "CC0 1.0 Universal Public Domain Dedication.", "This file is made available under the Creative Commons CC0 1.0 Universal Public Domain Dedication.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights.", "No rights reserved, dedicated to the public domain with CC0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GPL version 2 or later.", "Licensed under GPLv3.", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/", "Distributed under the terms of the GNU General Public License v2.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is distributed in the hope that it will be useful, but without any warranty; see the GNU General Public License for more details."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Distributed under the terms of the LGPL version 3.", "This library is free software; you can redistribute it under the GNU Lesser General Public License", "You should have received a copy of the GNU Lesser General Public License along with this library.", "SPDX-License-Identifier: LGPL-2.1-only", "This library is distributed under the GNU Lesser General Public License (LGPL).", "Released under the LGPL, version 2.1 or later."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Distributed under the MIT/X11 license.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT", "This project is open source under the MIT license; see LICENSE.", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the Mozilla Public License 2.0.", "Licensed under MPL 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0", "The contents of this file are subject to the Mozilla Public License Version 1.1.", "Distributed under the Mozilla Public License, version 2.0."],
    "proprietary": ["All rights reserved.", "Copyright 2020. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the copyright holder. All rights reserved.", "Confidential and proprietary. Unauthorized copying is prohibited. All rights reserved.", "This document contains proprietary and confidential information and may not be disclosed without written consent.", "Unauthorized reproduction or distribution is strictly prohibited; all rights are reserved by the publisher.", "Copyright by the company. All rights reserved worldwide.", "No license is granted to copy, modify or distribute this material."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "In jurisdictions that recognize copyright laws, the author of this software dedicates any and all copyright interest in the software to the public domain.", "For more information, please refer to https://unlicense.org", "SPDX-License-Identifier: Unlicense", "This code is in the public domain under the Unlicense."],
}
#: Paragraphs with cue words that grant nothing: fixed values.
OTHER = [
    "He renewed his driving license before the trip.", "The bar lost its license to sell alcohol last year.", "Poetic license allows a writer to bend the rules.", "She asked for permission to leave the room.", "The warranty covers parts for two years.",
    "Copyright law was changed by parliament.", "The court heard a copyright case on songs.", "Human rights groups met in the city.", "The license plate was hard to read.", "A fishing license costs little in this county.",
    "The agency may revoke the license of any carrier.", "The software crashed twice during the demonstration.", "New software for farms was shown at the fair.", "Music rights were sold to a large label.", "Reserved seats are held until eight.", "All rights of way must be kept open to walkers.",
    "The public library opens its reading room on Sundays.", "Creative people often work at night.", "Children need permission from a parent to take part.", "The minister defended the free market before parliament.", "The team released its new record under great applause.", "The photographer sued over copyright and lost the case.",
    "Conditions in the camp were poor.", "The company will distribute copies of the report to members.", "Use of the pool is free for guests.", "A general public meeting was held in the hall.", "The foundation published its yearly report on free schools.", "The licensed taxi waited at the station.",
    "The museum holds old maps in its public rooms.", "Students may apply for a software license at the office.", "The article explains how a license differs from a contract.", "Drivers without a licence are fined.", "The domain name was registered to the public library.",
]
#: Ordinary prose, about a window each, in the languages whose common words notices hold too: fixed values.
PROSE = [
    "This is all that is left of the old mill by the river. It was sold in 1902 or 1903, and all of the machines were taken away. You can still see the wheel, with no water under it, if you walk along the bank.",
    "The train leaves at 10 and is due at 12, or a little later in winter. All seats are in the second class. This year the line is closed for 4 weeks, so you may have to take a bus with your bags and see that you get off in time.",
    "In the general election of 1990 the party won 2 of the 12 seats. The new version of the bill was then sent back to the house, where it is to be read again. No date has been made known by the clerk.",
    "Version 2 of the plan was released in January 2020. It has 3 parts and is available to all members. The first part is about roads, the second about water, and the last one is about the way in which the work is to be paid for.",
    "Apache helicopters were sent to the north, and the crew of one was hurt under fire. The Apache and other peoples of the plains had lived there for long, by hunting and by trade, before the forts were built.",
    "She studied physics at MIT and then at Harvard, and was later made a professor. Her group at MIT works on cold atoms. This work, published in 2004, is among the most read in the field.",
    "Please see the notes above for more information on the course. The content is the same as last year, and the material is given out in class. If you miss a class, you can ask a friend for the notes or write to the teacher.",
    "The program begins at 8 with a work by Haydn and is to end by 10. Any person who comes late shall wait outside. The source of the second piece is not known, but it is written in the style of the time.",
    "He put the file on the table and asked her to read it. The following day she gave it back without a word. All of it was true, she said later, and there was no need to make any more of it.",
    "Universal health care is the subject of this book. Its author shows, with many details, how the new laws came into force in 12 countries, and to what extent the poor were included in each. It is a good book, and not too long.",
    "The code of the door is written on the back of the key. You should not give it to any other person. If you have lost it, go to the office with your name and number and you will be given another one.",
    "Commercial use of the harbour began under the kings of the north. By 1800 it was open to ships of all kinds. The site is now a park, and the only part of it that can be seen from the road is the wall.",
    "Mozilla made the browser that all of us had at that time. Its share of the market was 4 percent in 2004 and 20 percent by 2008, or more in some countries. The next version was faster but it came too late.",
    "The gnu is a large animal of the plains. It lives in herds with zebras, and is hunted by lions. All year long the herds move with the rain, and in the dry months they can be seen by the river in great numbers.",
    "No one is sure of the domain over which he ruled. By the terms of the treaty, this land and all that was on it was to be shared by the two sons. The lesser of them soon lost his part, and is not named again.",
    "To the editor: this is the third time in a month that the buses were late. All of us who use them pay the same. Is there no one at the company who can do a simple sum, or does no one care?",
    "Add 2 cups of flour, 1 egg and a little salt. Work it with your hands, and if it is too dry, add water. Let it rest under a cloth for 1 hour or more. Then cut it in 4, and fry it on both sides.",
    "The score was 1 to 0 at the half and 2 to 0 at the end. It was the 3rd win in a row for the team, which is now 4 points ahead. The coach said that all of the players had done what they were asked to do.",
    "This page is about the town. For other uses, see the list. The town has 3 schools, a church and a station, and is known for its fair, which is held each year on the first Sunday of May or June.",
    "My father was dedicated to his work, and to us. He would be up by 5 and not be back until 8 or 9, with all the news of the day. I have his letters, and his watch, and nothing more. This is how I think of him.",
    "All persons of any age are welcome. No charge is made for children under 12. The walk is 5 miles long and is not hard, but you should have good shoes. Dogs may come along if they are kept close by.",
    "Parts for this model are no longer made by the company. You may find used ones on the net, or ask at a shop. Take care that the number is the same as that on the back, or the one that you get will not fit.",
    "The clause was struck out by the judge. Neither side had agreed to it in writing, and it was not in the form that the act required. The case is to be heard again in 2021, and the costs are to be shared.",
    "Work on the bridge is to be done by the end of the year. The above prices are in dollars and include all taxes. Changes in the plan are possible at any time and without notice. The office is open from 9 to 5.",
    "No credit was given to those who had done the work, and no names were read. This document contains what they told us. It is written in their own words, and we have not changed any of it.",
    "Reserved by nature, she was not one to share her thoughts. All the same, she liked to see people, and to be among them. By the time she left, it is said, she knew the name of every one in the street.",
    "Do not copy what others do. Anyone can make a thing that sells; to make a thing that lasts is hard. Publish less, use more time, and be free of the wish to please. This is all the advice I can give.",
    "The files were in a box under the stairs, with a list of contents. Some had been used to light the fire. Those that were left, 2 or 3 hundred, are now in the town hall, where any of you may go and see them.",
    "Der Mann kam mit dem Zug und ging mit seiner Frau nach Hause. Es war kalt, und sie hatten nichts mit. Mit der Zeit wurde es besser, und sie konnten mit den Kindern in die Stadt fahren.",
    "Mit einem Wort: es ist nicht leicht. Wer mit offenen Augen durch die Stadt geht, der sieht, dass es so nicht weiter gehen kann. Die Leute sind unzufrieden mit der Regierung und mit sich selbst.",
    "Sie fuhr mit dem Rad in das Dorf und kam mit einem Korb voll Obst zurück. Die Kinder spielten im Garten, der Hund lag unter dem Tisch, und alle waren mit dem Tag zufrieden.",
    "Das Haus ist mit Holz gebaut und hat ein Dach aus Stein. Es wurde im Jahr 1850 von einem Bauern mit seinen Söhnen errichtet und steht noch heute an der Straße nach Norden.",
    "Zusammen mit den anderen hat er die Arbeit gemacht. Sie ist mit Sicherheit die beste, die in diesem Jahr zu sehen war. Mit ihr hat keiner gerechnet, auch nicht die Lehrer.",
    "Die Sitzung begann mit einer Rede und endete mit einem Streit. Der Minister sprach über die neuen Gesetze, die mit dem ersten Januar in Kraft treten, und über die Kosten, die damit verbunden sind.",
    "Mit freundlichen Grüßen. Bitte kommen Sie mit Ihrem Ausweis am Montag um 9 Uhr in das Büro. Wir werden dann mit Ihnen den Plan besprechen und Ihnen sagen, wie es mit dem Bau weiter geht.",
    "Im Wald ist es still. Man hört nur den Wind und das Wasser, das mit leisem Rauschen über die Steine läuft. Wer mit mir kommen will, der soll es jetzt sagen, denn der Weg ist lang.",
    "Komm mit.", "Er nahm den Hund mit.", "Mit der Zeit.", "Mit uns unter einem Dach.", "Der Tag begann mit Regen und hörte mit Regen auf.",
    "Was bringst du mit? Ich bringe Brot und Käse mit, und Anna kommt mit dem Wein. Mit etwas Glück bleibt es trocken, und wir können draußen sitzen, bis die Sonne untergeht.",
    "Der Verein spielt mit drei Stürmern, aber mit wenig Erfolg. Mit dem Trainer ist man trotzdem zufrieden. Am Samstag geht es mit einem Spiel gegen den Meister weiter, und alle fahren mit.",
    "Mit zwölf Jahren kam er in die Schule nach Wien, mit zwanzig war er Soldat, und mit dreißig hatte er mit seinem ersten Buch Erfolg. Er lebte mit seiner Schwester am Rand der Stadt.",
    "Sie sprach mit leiser Stimme, und nur die beiden, die mit ihr am Tisch saßen, konnten sie verstehen. Dann stand sie auf, ging mit schnellen Schritten zur Tür und nahm den Schlüssel mit.",
    "Man nehme einen Topf mit Wasser, würze mit Salz und koche die Kartoffeln mit der Schale. Danach mit Butter servieren. Wer will, isst Fisch mit dazu oder einen Salat mit Gurken.",
    "Kein Mensch weiß, was mit dem Schiff geschah. Es war mit Holz und Eisen beladen und sollte mit der Flut auslaufen. Mit ihm verschwanden der Kapitän und alle, die mit an Bord waren.",
    "Huset ligger under berget, och under vintern kommer ingen dit. Under kriget bodde två familjer där. De hade en ko och levde av det som skogen gav, och det var inte mycket.",
    "Byen ligger ved havet. Under festen er der musik i alle gader, og by og land kommer sammen. Der er plads til alle, og for de små er der en have med is og kager.",
    "Under the bridge, under a grey sky, two boys were fishing. They kept the bait under a stone. Nothing moved under the water, and by noon they had gone home to sleep under the trees.",
    "Under the old king there was peace. Under his son, and all the more under the son of that son, the land was at war. Many died, and those who lived hid under the ground or in the woods.",
    "Elle a pris sa valise et sa robe, puis elle est partie sans un mot. Son mari est resté dans la maison avec sa mère. Il ne savait pas que faire, ni à qui parler de sa peine.",
    "La ville est connue pour sa cathédrale et pour son marché, qui a lieu tous les samedis. On y vend des fruits, du pain et du vin de la région. Il y a aussi un musée et une école.",
    "Le ministre a dit que la loi serait votée avant la fin de 2020. Les conditions ne sont pas encore connues, mais le texte est déjà public. La version de la commission est plus courte.",
    "Dans sa lettre, il explique que le travail est fini et que le prix est de 2 000 francs. Sa réponse est attendue pour le 1 mai. On ne peut pas en dire plus sur le sujet.",
    "Il est possible de visiter le site avec un guide. La source se trouve à 4 kilomètres, et le chemin est long. Les enfants ont de la place pour jouer, et les parents peuvent se reposer.",
    "La casa es grande y tiene un jardín con flores. En el verano venía toda la familia, y por la noche se cenaba fuera. No era fácil, pero todos estaban contentos de estar juntos.",
    "El gobierno dijo que la ley general entra en vigor en enero de 2020. Los partidos no están de acuerdo, y la versión final no se conoce. Se espera que el texto se publique por partes.",
    "No se sabe con certeza el origen de la ciudad. Según el autor, fue fundada por los romanos en el siglo 1 o 2. Es un lugar universal, de gran valor para la historia y para el arte.",
    "El tren sale a las 10 y llega a las 12. Si usted no tiene billete, lo puede comprar en la estación o con el personal. El material se entrega al final del curso, sin costo.",
    "La città è bella e il mare è vicino. Non si può dire altro di questo posto, se non che la gente è buona e che si mangia bene. In estate ci sono 2 o 3 feste, e tutti sono per le strade.",
    "Het huis is oud en staat aan het water. Het is in 1850 gebouwd door een boer, die er met zijn vrouw en kinderen in ging wonen. Nu is het van de stad, en er is een school in.",
    "A cidade é conhecida por sua praia e por sua festa. Não há como ir sem ver o mar. O trem sai às 10 e chega às 12, com 2 ou 3 paradas, e o preço é o mesmo para todos.",
]
#: Tells unknown paragraphs from those that are not about licences; decides nothing else but what is kept for that count.
CUE = r"(?i)licen[cs]e|copyright|rights[\s#*/;%>-]+reserved|public[\s#*/;%>-]+domain|creative[\s#*/;%>-]+commons|redistribut|permission|\bCC[ -]BY|\bCC0|\bGPL|\bLGPL|\bMPL|software"
WORDS = r"[a-z0-9]+"
THRESHOLD, CONFIRM = 0.5, 0.6
UNKNOWN = "unknown"
BLANK = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
#: Half a window, in words: no template is longer.
SPAN = max(len(re.findall(WORDS, t.lower())) for texts in TEMPLATES.values() for t in texts)


def features(text: str) -> set[str]:
    w = re.findall(WORDS, text.lower())
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fit(rows: list[tuple[set[str], int]], n_classes: int, steps: int = 200) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(feature -> row, weights, intercepts) by gradient descent."""
    at = {n: i for i, n in enumerate(sorted(set().union(*(x for x, _ in rows))))}
    x, y = _matrix(rows, at), np.eye(n_classes)[[c for _, c in rows]]
    w, b = np.zeros((len(at), n_classes)), np.zeros(n_classes)
    for _ in range(steps):
        g = (_softmax(x @ w.astype(np.float32) + b) - y) / len(x)
        w -= 3.0 * (x.T @ g.astype(np.float32) + 1e-4 * w)
        b -= 3.0 * g.sum(0)
    return at, w, b


def _matrix(rows: list[tuple[set[str], int]], at: dict[str, int]) -> np.ndarray:
    m = np.zeros((len(rows), len(at)), np.float32)
    for i, (x, _) in enumerate(rows):
        m[i, [at[n] for n in x if n in at]] = 1
    return m


def _variants(notices: list[tuple[str, int]], rng: random.Random, many: int = 8) -> list[tuple[set[str], int]]:
    """Each notice, and copies of it with an eighth of the words left out."""
    out = []
    for t, c in notices:
        w = t.split()
        out.append((features(t), c))
        out += [(features(" ".join([x for x in w if rng.random() > 0.12] or w)), c) for _ in range(many)]
    return out


def notices() -> tuple[list[str], list[tuple[str, int]]]:
    """(classes, every notice with its class)."""
    classes = [*sorted(TEMPLATES), UNKNOWN]
    return classes, [(t, classes.index(f)) for f, texts in [*sorted(TEMPLATES.items()), (UNKNOWN, OTHER + PROSE)] for t in texts]


@functools.cache
def held_out(folds: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(logits, classes) of every notice by a model that saw neither it nor its variants."""
    classes, every = notices()
    logits, truth = np.zeros((len(every), len(classes))), np.array([c for _, c in every])
    place = np.zeros(len(every), int)
    for c in range(len(classes)):
        place[truth == c] = np.arange((truth == c).sum()) % folds
    for k in range(folds):
        at, w, b = _fit(_variants([every[i] for i in np.flatnonzero(place != k)], random.Random(seed), 3), len(classes), 120)
        test = np.flatnonzero(place == k)
        logits[test] = _matrix([(features(every[i][0]), 0) for i in test], at) @ w + b
    return logits, truth


@functools.cache
def train(seed: int = 7) -> tuple[list[str], dict[str, np.ndarray], np.ndarray]:
    """(classes, feature -> weight by class, intercepts) from all notices, divided by the temperature that suits held-out ones best."""
    classes, every = notices()
    z, truth = held_out()
    grid = np.exp(np.linspace(-1.5, 2.0, 71))
    best = min(grid, key=lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean())
    at, w, b = _fit(_variants(every, random.Random(seed)), len(classes))
    return classes, {n: w[i] / best for n, i in at.items()}, b / best


def model_table(spark: SparkSession) -> tuple[DataFrame, list[str], np.ndarray, list[tuple[str, int]]]:
    """(feature, weights, templates that hold it); classes; intercepts; (family, features) of each template. A few thousand rows."""
    classes, weights, bias = train()
    shown = [(f, features(t)) for f in sorted(TEMPLATES) for t in TEMPLATES[f]]
    rows = [(n, [float(v) for v in w], [int(n in x) for _, x in shown]) for n, w in weights.items()]
    return spark.createDataFrame(rows, "feature string, w array<double>, t array<int>"), classes, bias, [(f, len(x)) for f, x in shown]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


KEY = ["row", "doc_id", "paragraph", "unit", "begin", "end", "joined"]


def _scored(units: DataFrame) -> DataFrame:
    """units(KEY, words) with license, probability, whether it is known, and whether its family is confirmed."""
    table, classes, bias, shown = model_table(units.sparkSession)
    pairs = F.transform(F.arrays_zip(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))).alias("a"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))).alias("b")), lambda x: F.concat_ws(" ", x["a"], x["b"]))
    grams = units.select(*KEY, F.explode_outer(F.array_distinct(F.concat("words", pairs))).alias("feature"))
    met = grams.join(F.broadcast(table), "feature", "left")
    sums = [F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"z{i}") for i in range(len(classes))] + [F.coalesce(F.sum(F.col("t")[j]), F.lit(0)).alias(f"m{j}") for j in range(len(shown))]
    z = [F.col(f"z{i}") + float(v) for i, v in enumerate(bias)]
    top = F.greatest(*z)
    best = F.element_at(F.filter(F.array(*(F.when(v == top, F.lit(c)) for c, v in zip(classes, z, strict=True))), lambda x: x.isNotNull()), 1)
    total = sum((F.exp(v - top) for v in z[1:]), F.exp(z[0] - top))
    held = [F.when(F.lit(f) == F.col("license"), F.col(f"m{j}") / float(n)).otherwise(0.0) for j, (f, n) in enumerate(shown)]
    out = met.groupBy(*KEY).agg(*sums).withColumn("license", best).withColumn("probability", 1 / total)
    out = out.withColumn("known", (F.col("license") != UNKNOWN) & (F.col("probability") >= THRESHOLD))
    return out.select(*KEY, "license", "probability", "known", (F.col("known") & (F.greatest(*held) >= CONFIRM)).alias("confirmed"))


def _literal(values: Iterable[object], kind: str) -> Column:
    """An array literal; from one string, as thousands of literals of their own take seconds to plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _places(names: list[str]) -> tuple[list[int], list[int]]:
    """(shift of each of 4,096 groups, number from 1 of the name in each slot or 0) such that no two names share a slot.

    A name's group is its crc32's low 12 bits, its slot the other bits plus the group's shift, modulo the slots.
    """
    groups: dict[int, list[tuple[int, int]]] = {}
    for i, n in enumerate(names):
        h = zlib.crc32(n.encode())
        groups.setdefault(h & 4095, []).append((h >> 12, i + 1))
    for size in range(2 * len(names) + 1, 2 * len(names) + 1000):
        shifts, slots = [0] * 4096, [0] * size
        for g, members in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            free = lambda d: len({(h + d) % size for h, _ in members}) == len(members) and not any(slots[(h + d) % size] for h, _ in members)  # noqa: B023, E731
            shifts[g] = next(filter(free, range(size)), -1)
            if shifts[g] < 0:
                break
            for h, i in members:
                slots[(h + shifts[g]) % size] = i
        else:
            return shifts, slots
    raise ValueError("two features have one crc32")


def _possible() -> Callable[[Column, Column], Column]:
    """words, spans (array of struct(at, n), at from 1) -> whether the model may know a licence in any span.

    Known means that some family is likelier than unknown, so this drops no known span: it adds up
    the same weights as _scored, less those of unknown, with a margin for the order of the sums.
    """
    classes, weights, bias = train()
    u = classes.index(UNKNOWN)
    names = sorted(weights)
    alone, twofold = [n for n in names if " " not in n], [n for n in names if " " in n]
    shifts, slots = _places(names)
    size, shift, slot, order = len(slots), _literal(shifts, "int"), _literal(slots, "int"), _literal(names, "string")
    gain = np.array([weights[n] - weights[n][u] for n in names])
    sums = [(float(bias[c] - bias[u]), _literal((repr(float(v)) for v in gain[:, c]), "double")) for c in range(len(classes)) if c != u]

    def number(name: Column, known: list[str]) -> Column:
        crc = F.crc32(name.cast("binary"))
        at = (F.shiftright(crc, 12) + F.element_at(shift, (crc.bitwiseAND(F.lit(4095)) + 1).cast("int"))) % size + 1
        return F.when(name.isin(known), F.element_at(slot, at.cast("int"))).otherwise(0)

    def pair(a: Column, b: Column) -> Column:
        return F.when((a > 0) & (b > 0), number(F.concat_ws(" ", F.element_at(order, a), F.element_at(order, b)), twofold)).otherwise(0)

    def likely(found: Column) -> Column:
        odds = lambda b, w: F.aggregate(found, F.lit(b), lambda z, i: z + F.element_at(w, i))
        return F.greatest(*(odds(b, w) for b, w in sums)) >= -1e-6

    def some(single: Column, double: Column, spans: Column) -> Column:
        inside = lambda s: F.concat(F.slice(single, s["at"], s["n"]), F.slice(double, s["at"], F.greatest(s["n"] - 1, F.lit(0))))
        return F.exists(F.transform(spans, lambda s: F.array_distinct(F.filter(inside(s), lambda i: i > 0))), likely)

    return lambda words, spans: _let(
        F.transform(words, lambda w: number(w, alone)),
        lambda single: _let(F.zip_with(single, F.slice(single, 2, F.size(single)), pair), lambda double: some(single, double, spans)),
    )


def _starts(n: Column) -> Column:
    """The number of each window over n words."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / SPAN).cast("int") - 2))


def _spans(lines: Column) -> Column:
    """lines: array of arrays of words -> (at, n) of every line and window that may be scored."""
    ends = F.aggregate(lines, F.array(F.lit(0)), lambda z, x: F.concat(z, F.array(F.element_at(z, -1) + F.size(x))))
    return _let(
        ends,
        lambda e: F.concat(
            F.filter(F.zip_with(F.slice(e, 1, F.size(lines)), F.slice(e, 2, F.size(lines)), lambda a, b: F.struct((a + 1).alias("at"), (b - a).alias("n"))), lambda s: (s["n"] > 0) & (s["n"] <= 2 * SPAN)),
            F.transform(F.filter(_starts(F.element_at(e, -1)), lambda k: F.element_at(e, -1) > k * SPAN), lambda k: F.struct((k * SPAN + 1).alias("at"), F.lit(2 * SPAN).alias("n"))),
        ),
    )


def paragraphs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of all paragraphs those that may hold a licence or have a cue word, and the documents that have none of these.

    (row, doc_id, paragraph, cue, found); found: array of (license, probability, confirmed), empty if
    unknown. (doc_id) of the others.
    """
    possible = _possible()
    split = lambda body: F.transform(F.split(body, "\n"), _words)
    holds = lambda body: _let(split(body), lambda x: possible(F.flatten(x), _spans(x)))
    alone = lambda words: possible(words, F.array(F.struct(F.lit(1).alias("at"), F.size(words).alias("n"))))
    parts = F.transform(F.split("text", BLANK), lambda body, i: F.struct(i.alias("paragraph"), F.when(holds(body) | body.rlike(CUE), body).alias("body")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce(F.filter(parts, lambda x: x["body"].isNotNull()), F.array().cast("array<struct<paragraph:int,body:string>>")).alias("parts"))
    rows = materialize(rows)
    bodies = rows.select("row", "doc_id", F.inline("parts")).withColumn("cue", F.col("body").rlike(CUE))
    lines = bodies.select("row", "doc_id", "paragraph", F.posexplode(F.split("body", "\n")).alias("unit", "line"))
    lines = lines.select("row", "doc_id", "paragraph", "unit", F.col("unit").alias("begin"), F.col("unit").alias("end"), F.lit(False).alias("joined"), _words(F.col("line")).alias("words"))
    # longer lines are judged by windows alone, as they may hold several notices
    first = materialize(_scored(lines.where(F.size("words").between(1, 2 * SPAN)).where(alone(F.col("words")))))
    # a confirmed line is a whole notice; windows run over the other lines
    whole = first.where("confirmed").groupBy("row", "paragraph").agg(F.collect_set("unit").alias("whole"))
    at = F.transform(F.split("body", "\n"), lambda x, i: F.when(F.coalesce(F.array_contains("whole", i), F.lit(False)), F.array().cast("array<struct<w:string,i:int>>")).otherwise(F.transform(_words(x), lambda w: F.struct(w.alias("w"), i.cast("int").alias("i")))))
    left = bodies.join(whole, ["row", "paragraph"], "left").select("row", "doc_id", "paragraph", F.size(F.split("body", "\n")).alias("n_lines"), F.flatten(at).alias("words"))
    left = left.where((F.size("words") > 0) & ((F.col("n_lines") > 1) | (F.size("words") > 2 * SPAN)))
    cut = left.select("row", "doc_id", "paragraph", F.posexplode(F.transform(_starts(F.size("words")), lambda k: F.slice("words", k * SPAN + 1, F.lit(2 * SPAN)))).alias("unit", "part"))
    windows = cut.select("row", "doc_id", "paragraph", "unit", F.element_at("part", 1)["i"].alias("begin"), F.element_at("part", -1)["i"].alias("end"), F.lit(True).alias("joined"), F.transform("part", lambda x: x["w"]).alias("words")).where(alone(F.col("words")))
    out = first.where("known").unionByName(_scored(windows).where("known")).select("row", "doc_id", "paragraph", F.lit(False).alias("cue"), F.struct("begin", "end", "joined", "license", "probability", "confirmed").alias("unit"))
    out = out.unionByName(bodies.select("row", "doc_id", "paragraph", "cue", F.lit(None).cast(out.schema["unit"].dataType).alias("unit")))
    found = out.groupBy("row", "doc_id", "paragraph").agg(F.max("cue").alias("cue"), F.collect_list("unit").alias("all"))
    # lines that are not confirmed may be known too: a window over them counts if it is confirmed
    inside = lambda u: F.exists("all", lambda v: ~v["joined"] & (v["begin"] >= u["begin"]) & (v["begin"] <= u["end"]))
    found = found.select("row", "doc_id", "paragraph", "cue", F.filter("all", lambda u: ~u["joined"] | u["confirmed"] | ~inside(u)).alias("found"))
    return found, rows.where(F.size("parts") == 0).select("doc_id")


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> licenses (sorted families, comma-joined), confirmed ones, and counts."""
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda u: u["license"]))), ",")
    known = F.size("found") > 0
    some, none = paragraphs(docs)
    found = some.groupBy("row", "doc_id").agg(F.flatten(F.collect_list("found")).alias("units"), F.sum(known.cast("long")).alias("n_license_paragraphs"), F.sum((~known & F.col("cue")).cast("long")).alias("n_unknown_paragraphs"))
    found = found.select(
        "doc_id", names(F.col("units")).alias("licenses"), names(F.filter("units", lambda u: u["confirmed"])).alias("confirmed"), "n_license_paragraphs", "n_unknown_paragraphs",
        F.round(F.array_max(F.transform("units", lambda u: u["probability"])), 6).alias("probability"),
    )
    rest = none.select("doc_id", F.lit("").alias("licenses"), F.lit("").alias("confirmed"), F.lit(0).cast("long").alias("n_license_paragraphs"), F.lit(0).cast("long").alias("n_unknown_paragraphs"), F.lit(None).cast("double").alias("probability"))
    return found.unionByName(rest)
