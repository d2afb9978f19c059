"""litgraph: literature and collaborator analytics as Spark DataFrame plans.

Subpackages
-----------
sources    readers and writers: nested bibliographic records (XML), document
           tables, dimension tables, vector / graph / map-feature sinks
functions  column expressions: affiliation parsing, display text, search
           predicates, vector maths
operators  DataFrame -> DataFrame operators: author extraction and merge,
           places, display tables, ranked search, embeddings, similarity
           join, graph, clustering
plans      the end-to-end pipeline and the registry of named queries

Every operator is a plain function that takes and returns DataFrames, so it
composes with ``df.transform``.  No operator collects rows to the driver;
the only driver-side values are counts used to size blocks or end loops.
"""

__version__ = "0.1.0"
