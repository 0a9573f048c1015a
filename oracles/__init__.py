"""Checking SQL for the registered queries (one DuckDB statement per query)."""


def ORACLES() -> dict[str, str]:
    from oracles import section_a, section_bcd, section_efgh, section_ij

    return section_a.SQL | section_bcd.SQL | section_efgh.SQL | section_ij.SQL
