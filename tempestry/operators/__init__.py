"""DataFrame operators: temporal and spatial joins, profiles, fusion, fits, sequences and stencils."""
