"""All registered core queries."""

from tracequarry.plans import changes, code_queries, finding_queries, rule_queries, scanner_queries, whole_queries

QUERIES = {**changes.QUERIES, **rule_queries.QUERIES, **finding_queries.QUERIES, **code_queries.QUERIES, **scanner_queries.QUERIES, **whole_queries.QUERIES}
FLAGSHIP = "q_ranked_findings"
