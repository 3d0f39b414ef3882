"""All queries of the collection operators, with the SQL that checks them."""

from . import evidence, exports, lifecycle, matching, measures, pictures, reporting, review, scoring, selection, state

QUERIES = scoring.QUERIES | matching.QUERIES | lifecycle.QUERIES | selection.QUERIES | reporting.QUERIES | state.QUERIES | evidence.QUERIES | measures.QUERIES | review.QUERIES | pictures.QUERIES | exports.QUERIES
ORACLE = scoring.ORACLE | matching.ORACLE | lifecycle.ORACLE | selection.ORACLE | reporting.ORACLE | state.ORACLE | evidence.ORACLE | measures.ORACLE | review.ORACLE | pictures.ORACLE | exports.ORACLE
WITHOUT_SQL = selection.WITHOUT_SQL | reporting.WITHOUT_SQL
