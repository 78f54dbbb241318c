"""Where rows come from: tables seen as a graph, landing files, traces."""
