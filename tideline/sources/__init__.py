"""Where change logs come from: captured files, generators, the fixture over the test tables."""
