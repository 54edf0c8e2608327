"""Modules of the core that offer queries (``QUERIES``) with their SQL (``ORACLE``)."""

MODULES = ["corpuscle.operators.incremental", "corpuscle.operators.corpus", "corpuscle.operators.grep", "corpuscle.operators.search", "corpuscle.operators.vector", "corpuscle.operators.scan", "corpuscle.operators.edges", "corpuscle.operators.documents", "corpuscle.operators.extract", "corpuscle.operators.validate", "corpuscle.operators.store", "corpuscle.operators.sync", "corpuscle.operators.lookup", "corpuscle.streaming.changes"]
