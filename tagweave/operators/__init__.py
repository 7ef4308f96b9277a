"""Table-level operators: parse, frequency filter, judge, export, score, report, split."""
