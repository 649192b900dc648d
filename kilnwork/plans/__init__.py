"""Building blocks that operators share: stored intermediates, running totals, graph loops."""
