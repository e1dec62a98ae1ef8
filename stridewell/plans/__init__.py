"""Named queries over the tables of a data folder, with SQL of the same meaning where SQL can say it."""
