"""A Spark-native knowledge-graph engine: graphs from tables, SPARQL over them, and operators for training data."""

from .model import Model, SolutionMappings, add_triples
from .templates.ast import Argument, Instance, Parameter, Template, Triple
from .templates.as_rdf import generate_templates
from .terms import IRI, BlankNode, GraphError, Literal, Prefix, RDFType, Variable, owl, rdf, rdfs, xsd

__all__ = [
    "IRI", "Argument", "BlankNode", "GraphError", "Instance", "Literal", "Model", "Parameter", "Prefix", "RDFType", "SolutionMappings", "Template",
    "Triple", "Variable", "add_triples", "generate_templates", "owl", "rdf", "rdfs", "xsd",
]
