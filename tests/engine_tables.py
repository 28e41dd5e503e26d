"""Where the engine's tests find their tables."""

SF = "/root/testdata/sf0.001"
