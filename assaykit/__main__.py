from assaykit.cli import main

main()
