"""Jobs built from the operators: the stage runner over tables, report frames, and the
registered (oracle-checked) queries over the supplied test tables."""
