"""RDFS entailment: rules as CONSTRUCT queries, run to a fixpoint."""

from __future__ import annotations

from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from .model import Model

#: Rule -> (what follows, from what).
RULES = {
    2: ("?s a ?class", "?s ?p ?o . ?p rdfs:domain ?class"),
    3: ("?o a ?class", "?s ?p ?o . ?p rdfs:range ?class FILTER(!isLiteral(?o))"),
    5: ("?p rdfs:subPropertyOf ?r", "?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?r"),
    6: ("?p rdfs:subPropertyOf ?p", "?p a rdf:Property"),
    7: ("?s ?q ?o", "?s ?p ?o . ?p rdfs:subPropertyOf ?q"),
    8: ("?c rdfs:subClassOf rdfs:Resource", "?c a rdfs:Class"),
    9: ("?s a ?d", "?s a ?c . ?c rdfs:subClassOf ?d"),
    10: ("?c rdfs:subClassOf ?c", "?c a rdfs:Class"),
    11: ("?c rdfs:subClassOf ?e", "?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?e"),
}
#: Steps in order; those marked repeat until nothing is new.
ORDER = (((6,), False), ((5,), True), ((7,), False), ((2, 3, 8), False), ((10, 11), True), ((9,), False))


def infer_rdfs(model: Model, graph: str | None = None, transient: bool = True) -> int:
    total = 0
    for rules, again in ORDER:
        while True:
            new = 0
            for rule in rules:
                head, body = RULES[rule]
                for _, df in model.insert(f"CONSTRUCT {{ {head} }} WHERE {{ {body} }}", source_graph=graph, target_graph=graph, transient=transient):
                    new += df.count()
            total += new
            if not (again and new):
                break
    return total
