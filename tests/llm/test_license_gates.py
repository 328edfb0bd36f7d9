import itertools
import re
from re import _parser

from gaugeflow.llm import licenses


def branches(pattern):
    """Texts, one at least for each branch of a pattern."""

    def of(parsed):
        parts = []
        for kind, arg in parsed:
            name = str(kind)
            if name == "LITERAL":
                parts.append([chr(arg)])
            elif name == "IN":
                parts.append([chr(a) if str(k) == "LITERAL" else "2" for k, a in arg])
            elif name == "SUBPATTERN":
                parts.append(of(arg[-1]))
            elif name == "BRANCH":
                parts.append([x for b in arg[1] for x in of(b)])
            elif name == "MAX_REPEAT":
                parts.append(([""] if arg[0] == 0 else []) + of(arg[2]))
            else:
                raise ValueError(name)
        return ["".join(x) for x in itertools.product(*parts)]

    return of(_parser.parse(pattern))


def test_every_branch_of_every_name_passes_its_gate():
    shapes = {1: "spdx license identifier {}", 2: "released under {}", 3: "{} agreement", 4: "{} 2 0"}
    tried = 0
    for rule in licenses.default_rules():
        names = [n for label, (_, n, _) in licenses.FAMILIES.items() if label.removesuffix("-short").removesuffix("-long") == rule.label]
        for text in {shapes.get(rule.priority, "{}").format(b) for n in names for b in branches(n)}:
            # "mit" before a number is a German word: only with another word of a license near.
            if re.fullmatch(rule.pattern, text) and text != "mit 2 0":
                tried += 1
                assert any(set(k) <= set(text.split()) for k in rule.keywords), (rule.label, text)
    assert tried > 400


def test_names_written_out_are_found(spark):
    want = {
        "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": ("cc-by-sa", 0.9), "Creative Commons Attribution 4.0": ("cc-by", 0.5),
        "Creative Commons Attribution-NonCommercial-NoDerivs license": ("cc-by-nc-nd", 0.7), "the New BSD license": ("bsd-3-clause", 0.7), "Simplified BSD License": ("bsd-2-clause", 0.7),
        "released under the original BSD license": ("bsd-4-clause", 0.9), "FreeBSD license": ("bsd", 0.7), "Released under MIT": ("mit", 0.9),
    }
    found = licenses.scan_licenses(spark.createDataFrame([(t,) for t in want], "text string")).collect()
    for r in found:
        assert want[r["text"]] in {(d["label"], d["confidence"]) for d in r["detections"]}, r
    assert not licenses.scan_licenses(spark.createDataFrame([("Er kam mit 20 Jahren",)], "text string")).first()["detections"]
