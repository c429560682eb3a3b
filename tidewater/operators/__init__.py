"""Table operators: shaping, filters, joins, unions, aggregates, windows, reshaping."""
