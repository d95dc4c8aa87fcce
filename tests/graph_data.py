"""Where the tables of the graph tests are."""

SF = "/root/testdata/sf0.01"
