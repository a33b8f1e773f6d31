"""From C and C++ text to a code property graph, function by function."""
