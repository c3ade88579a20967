"""Functions over columns, one module for each subject. Null arguments give null unless a docstring says otherwise."""
