"""paperloom: corpus analytics over tables of source files and documents."""
