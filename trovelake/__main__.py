from trovelake.cli import main

main()
